"""Catalog sync, reconciliation and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scores import format_inr, price_digits
from opsframe.functions.text import norm_text, platform_of, strip_image_proxy, url_tail
from opsframe.operators.keyed import first_per_key, last_per_key


def search_catalog(df: DataFrame, query: str) -> DataFrame:
    q = norm_text(F.lit(query))
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.contains(norm_text(F.col(c)), q), F.lit(False)) for c in ("name", "id", "url")))
    return df.where((q == "") | hit)


def needs_enrichment(df: DataFrame, low: int = 50) -> DataFrame:
    """With a URL, and a field missing or a price of 1 to below `low`."""
    missing = reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit("")) == "" for c in ("price", "category", "brand", "mrp_price")))
    cheap = (price_digits(F.col("price")) > 0) & (price_digits(F.col("price")) < low)
    return df.where((F.coalesce(F.col("url"), F.lit("")) != "") & (missing | F.coalesce(cheap, F.lit(False))))


def missing_fields(df: DataFrame, mode: str) -> DataFrame:
    b, c = F.col("brand").isNull(), F.col("category").isNull()
    return df.where({"brand": b, "category": c, "either": b | c, "price": F.col("price").isNull() | F.col("mrp_price").isNull()}[mode])


def new_products(snapshot: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshot rows whose URL isn't stored, first of each id."""
    fresh = snapshot.join(stored.select("url"), "url", "left_anti")
    return first_per_key(fresh, ["item_id"], ["url"])


def sync_plan(snapshot: DataFrame, stored: DataFrame) -> DataFrame:
    """Missing both by trailing id and by URL."""
    ids = stored.select(url_tail(F.col("url")).alias("item_id"))
    return snapshot.join(ids, "item_id", "left_anti").join(stored.select("url"), "url", "left_anti")


def reconcile(stored: DataFrame, active: DataFrame) -> DataFrame:
    """state (inactive or missing) and item_id: stored but not active, and active but not stored."""
    s = stored.select(url_tail(F.col("url")).alias("item_id"))
    a = active.select("item_id")
    out = s.join(a, "item_id", "left_anti").withColumn("state", F.lit("inactive"))
    return out.unionByName(a.distinct().join(s, "item_id", "left_anti").withColumn("state", F.lit("missing")))


def backfill_images(products: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Empty images from the snapshot by URL, the last entry of a URL first; proxies stripped."""
    last = last_per_key(snapshot.select("url", F.col("image_url").alias("found"), "num"), ["url"], ["num"]).select("url", "found")
    joined = products.join(last, "url", "left")
    image = strip_image_proxy(F.coalesce(F.nullif(F.col("image_url"), F.lit("")), F.col("found")))
    return joined.withColumn("image_url", image).drop("found")


def enrich(products: DataFrame, gateway: DataFrame) -> DataFrame:
    """Missing fields from the gateway, field by field; a zero price counts as missing, mrp falls back to price."""
    g = gateway.select("id", *(F.nullif(F.col(c), F.lit("")).alias(f"g_{c}") for c in ("price", "category", "brand")))
    j = products.join(g, "id", "left")
    price = F.coalesce(F.when(price_digits(F.col("price")) > 0, F.col("price")), F.col("g_price"))
    return j.select("id", price.alias("price"), F.coalesce(F.nullif(F.col("mrp_price"), F.lit("")), price).alias("mrp_price"), F.coalesce("category", "g_category").alias("category"), F.coalesce("brand", "g_brand").alias("brand"))


def title_drift(products: DataFrame, fresh: DataFrame) -> DataFrame:
    """outcome, n: stored titles against fresh ones (id, fresh_title)."""
    j = products.select("id", "name").join(fresh, "id", "left")
    outcome = F.when(F.col("fresh_title").isNull(), "no_page").when(F.col("fresh_title") == "", "error").when(F.col("fresh_title") == F.col("name"), "same").otherwise("updated")
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def check_constraints(df: DataFrame, not_null: list[str], enums: dict[str, list[str]], unique: list[str]) -> DataFrame:
    """rule, n: rows that break each rule."""
    rules = {f"not_null:{c}": F.col(c).isNull() for c in not_null} | {f"enum:{c}": ~F.col(c).isin(v) for c, v in enums.items()}
    # one pass for the row rules
    counts = df.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()))
    rows = counts.select(F.explode(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(f"`{name}`"))])).alias("rule", "n"))
    doubled = df.groupBy(*unique).count().where("count > 1").agg(F.lit(f"unique:{','.join(unique)}").alias("rule"), F.count("*").alias("n"))
    return rows.unionByName(doubled)


def check_requests(requests: DataFrame, platforms: list[str], most: int = 5) -> DataFrame:
    """The requests and their `violations`: a number of products other than 1 to `most`, a product without id or name, an unknown platform.

    products is array<struct<id,name>>, null for none; platforms is array<string>, null for the default ones.
    """
    n = F.coalesce(F.size("products"), F.lit(0))
    rules = {
        "products": (n < 1) | (n > most),
        "fields": F.coalesce(F.exists("products", lambda p: p["id"].isNull() | p["name"].isNull()), F.lit(False)),
        "platform": F.coalesce(F.exists("platforms", lambda p: F.coalesce(~p.isin(platforms), F.lit(True))), F.lit(False)),
    }
    return requests.withColumn("violations", F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items()))))


def merge_detail(listing: DataFrame, detail: DataFrame, columns: list[str], key: str = "url") -> DataFrame:
    """Each listing row with a detail row's filled columns first: status success, else extracted from the listing, else failed.

    '' counts as missing; detail has one row a key. A detail row with nothing in `columns` counts as none.
    """
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    d = detail.select(key, *(filled(c).alias(f"__{c}") for c in columns))
    some = lambda names: F.coalesce(*names).isNotNull()
    status = F.when(some([F.col(f"__{c}") for c in columns]), "success").when(some([filled(c) for c in columns]), "extracted").otherwise("failed")
    j = listing.join(d, key, "left").withColumn("status", status)
    return j.withColumns({c: F.coalesce(F.col(f"__{c}"), filled(c)) for c in columns}).drop(*(f"__{c}" for c in columns))


def catalog_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def mapping_status(products: DataFrame, mappings: DataFrame) -> DataFrame:
    """id, name, attempted, mapped, duplicate."""
    m = mappings.select(
        F.col("product_id").alias("id"),
        (F.col("amazon_url").isNotNull() | F.col("flipkart_url").isNotNull()).alias("mapped"),
        F.get_json_object("search_error", "$.duplicate_of").isNotNull().alias("duplicate"),
        F.lit(True).alias("attempted"),
    )
    j = products.select("id", "name").join(m, "id", "left")
    return j.select("id", "name", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("attempted", "mapped", "duplicate")))


def facet_filter(status: DataFrame, facet: str, query: str = "") -> DataFrame:
    rule = {"all": F.lit(True), "mapped": F.col("mapped"), "unmapped": ~F.col("mapped") & ~F.col("duplicate"), "duplicates": F.col("duplicate")}[facet]
    return status.where(rule & F.contains(F.lower("name"), F.lit(query.lower())))


def facet_counts(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count("*").alias("total"), F.count_if("attempted").alias("attempted"), F.count_if("mapped").alias("mapped"), F.count_if("duplicate").alias("duplicates"), F.count_if(~F.col("mapped") & ~F.col("duplicate")).alias("unmapped")
    )


def mapping_export(mappings: DataFrame) -> DataFrame:
    """Similarities as whole percents, half up, and availability as Yes or No."""
    return mappings.select("product_id", F.concat(F.floor(F.col("amazon_dinov2") * 100 + 0.5).cast("string"), F.lit("%")).alias("similarity"), F.when(F.col("amazon_unavailable"), "Yes").otherwise("No").alias("unavailable"))


def plan_scrape(sheet: DataFrame, force: bool = False) -> DataFrame:
    """sheet (row, url, status) with platform, outcome and error: `scrape`, or `failed` for an empty URL or an unsupported domain.

    Rows whose status is `success` in any case are left out unless forced. A null
    status is not yet a success; a null URL is empty.
    """
    url = F.trim(F.coalesce("url", F.lit("")))
    rows = sheet if force else sheet.where(F.lower(F.trim(F.coalesce("status", F.lit("")))) != "success")
    error = F.when(url == "", "Empty URL").when(F.col("platform").isNull(), F.concat(F.lit("Unsupported domain: "), url))
    planned = rows.select("row", url.alias("url"), platform_of(url).alias("platform"))
    return planned.withColumn("error", error).withColumn("outcome", F.when(F.col("error").isNull(), "scrape").otherwise("failed"))


def todo(rows: DataFrame, done: DataFrame, key: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows whose key is not among those done, the first `limit` of the order if one is given. Null keys are never done."""
    rest = rows.join(done.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return rest.orderBy(*order).limit(limit) if limit else rest


ITEM = "struct<productId:string,skuId:string,productName:string,variantName:string,price:string,mrpPrice:string,containerName:string,image:string,productSlug:string,itemId:string,categorySlug:string,categoryName:string>"


def parse_items(bodies: DataFrame, site: str, images: str) -> DataFrame:
    """id, name, price, image_url, url, category of the items in JSON arrays (seq, body); the first of each id stays.

    Names, prices and categories fall back on their second field; an item without any
    id gets a hash of its URL and name. A body that is no array has no items.
    """
    items = bodies.select("seq", F.posexplode(F.from_json("body", f"array<{ITEM}>")).alias("at", "i")).where("i is not null").select("seq", "at", "i.*")
    some = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))
    value = some("price", "mrpPrice").try_cast("double")
    cents = F.rtrim(F.regexp_replace(F.format_string("%.3f", value), r"^-?\d+", ""), F.lit("0"))
    image = F.when(F.startswith("image", F.lit("http")), F.col("image")).otherwise(F.concat(F.lit(f"{images}/"), F.coalesce("containerName", F.lit("")), F.nullif(F.col("image"), F.lit("")), F.lit("?height=300&width=300")))
    own_url = F.concat(F.lit(f"{site}/product-detail/"), some("productSlug"), F.lit("/"), some("itemId"))
    flat = items.select(
        "seq",
        "at",
        some("productId", "skuId").alias("key"),
        F.coalesce(some("productName", "variantName"), F.lit("Unknown Product")).alias("name"),
        F.when(value.isNotNull(), F.concat(format_inr(F.floor(value)), F.rtrim(cents, F.lit(".")))).alias("price"),
        image.alias("image_url"),
        F.coalesce(own_url, F.lit(f"{site}/product-list/all")).alias("url"),
        some("categorySlug", "categoryName").alias("category"),
    )
    keyed = flat.withColumn("id", F.concat(F.lit("item-"), F.coalesce("key", F.sha2(F.concat("url", "name"), 256))))
    return first_per_key(keyed, ["id"], ["seq", "at"]).select("id", "name", "price", "image_url", "url", "category")
