"""Readers of tables, sheets, records and embedded JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_sheet_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every cell a string, blanks as empty strings."""
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(path).na.fill("")


def read_records_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parse_sitemaps(xml: DataFrame, column: str = "text") -> DataFrame:
    """item_id, url, title, image_url of each <url> entry; an entry without an image has null, and others don't shift."""
    entries = xml.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<url>(.*?)</url>"), 1)).alias("e"))
    tag = lambda name: F.nullif(F.regexp_extract("e", rf"(?s)<{name}>(.*?)</{name}>", 1), F.lit(""))
    url = F.nullif(F.regexp_extract("e", r"(?s)<loc>(.*?)</loc>", 1), F.lit(""))
    return entries.select(F.substring_index(url, "/", -1).alias("item_id"), url.alias("url"), F.coalesce(tag("image:title"), F.lit("Unknown Product")).alias("title"), tag("image:loc").alias("image_url"))


def parse_sitemaps_by_position(xml: DataFrame, column: str = "text") -> DataFrame:
    """As parse_sitemaps, but the n-th image and title of a sitemap go to its n-th url, so that one that is missing shifts those behind it."""
    every = lambda tag: F.regexp_extract_all(column, F.lit(rf"<{tag}>([^<]*)</{tag}>"), 1)
    lists = xml.select(every("loc").alias("urls"), every("image:loc").alias("images"), every("image:title").alias("titles"))
    each = lists.select("images", "titles", F.posexplode("urls").alias("at", "url")).where("url <> ''")
    return each.select(
        F.substring_index("url", "/", -1).alias("item_id"), "url", F.coalesce(F.trim(F.get("titles", F.col("at"))), F.lit("Unknown Product")).alias("title"), F.nullif(F.get("images", F.col("at")), F.lit("")).alias("image_url")
    )


def parse_gateway(df: DataFrame, body: str = "body") -> DataFrame:
    """price, mrp, category, brand of gateway JSON; the default SKU's price comes first, else the first SKU's."""
    kind = "struct<price:string,mrpPrice:string,brandName:string,Category:array<struct<categoryName:string>>,skuList:array<struct<isDefault:int,price:string,mrpPrice:string>>>"
    p = df.withColumn("p", F.from_json(body, kind))
    sku = F.coalesce(F.try_element_at(F.filter("p.skuList", lambda s: s["isDefault"] == 1), F.lit(1)), F.try_element_at("p.skuList", F.lit(1)))
    return p.withColumn("sku", sku).select(
        "id",
        F.coalesce("sku.price", "p.price").alias("price"),
        F.coalesce("sku.mrpPrice", "p.mrpPrice").alias("mrp_price"),
        F.try_element_at("p.Category", F.lit(1))["categoryName"].alias("category"),
        F.col("p.brandName").alias("brand"),
    )


def parse_search_results(df: DataFrame, body: str = "body") -> DataFrame:
    """title, url, price under any of their alternate keys, in a `data` list or a bare one; '' counts as missing."""
    item = "array<struct<title:string,name:string,url:string,link:string,price:string,sellingPrice:string>>"
    items = F.coalesce(F.from_json(F.get_json_object(body, "$.data"), item), F.from_json(body, item))
    i = df.select("id", F.posexplode(items).alias("rank", "i"))
    pick = lambda *names: F.coalesce(*(F.nullif(F.col(f"i.{n}"), F.lit("")) for n in names))
    return i.select("id", "rank", pick("title", "name").alias("title"), pick("url", "link").alias("url"), pick("price", "sellingPrice").alias("price"))


def parse_audit(df: DataFrame, body: str = "report") -> DataFrame:
    """page, metric, value: named audits, rounded half-even to 2 places; absent ones are left out."""
    paths = {
        "lcp_ms": "$.audits.largest-contentful-paint.numericValue",
        "cls": "$.audits.cumulative-layout-shift.numericValue",
        "tbt_ms": "$.audits.total-blocking-time.numericValue",
        "fcp_ms": "$.audits.first-contentful-paint.numericValue",
        "si_ms": "$.audits.interactive.numericValue",
    }
    values = {"performance_score": F.get_json_object(body, "$.categories.performance.score").cast("double") * 100}
    values |= {k: F.get_json_object(body, p).cast("double") for k, p in paths.items()}
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.bround(v, 2))])
    return df.select("page", F.explode(F.map_filter(pairs, lambda _, v: v.isNotNull())).alias("metric", "value"))


def parse_field_data(df: DataFrame, body: str = "report") -> DataFrame:
    """Score and three percentiles, 0 where absent."""
    at = lambda p: F.coalesce(F.get_json_object(body, p).cast("double"), F.lit(0.0))
    base = "$.loadingExperience.metrics"
    return df.select(
        "page",
        (at("$.lighthouseResult.categories.performance.score") * 100).alias("score"),
        at(f"{base}.LARGEST_CONTENTFUL_PAINT_MS.percentile").alias("lcp"),
        at(f"{base}.CUMULATIVE_LAYOUT_SHIFT_SCORE.percentile").alias("cls"),
        at(f"{base}.INTERACTION_TO_NEXT_PAINT.percentile").alias("inp"),
    )


def explode_listing(df: DataFrame, html: str = "html") -> DataFrame:
    """Products of a listing's embedded state, first of each (slug, product_id)."""
    product = "struct<slug:string,product_id:string,name:string,min_product_price:double,price:double,images:array<struct<url:string>>>"
    state = F.regexp_extract(html, r"(?s)<script id=\"__STATE__\"[^>]*>(.*?)</script>", 1)
    keys = ("listing", "shopListing", "searchListing", "collectionListing")
    pages = [F.from_json(F.get_json_object(state, f"$.{k}.pages"), f"array<struct<products:array<{product}>>>") for k in keys]
    found = F.flatten(F.transform(F.coalesce(*pages), lambda p: F.coalesce(p["products"], F.array().cast(f"array<{product}>"))))
    rows = df.select("url", F.posexplode(found).alias("pos", "p"))
    one = rows.select(
        "url",
        "pos",
        F.regexp_replace(F.lower("p.slug"), "[^a-z0-9-]+", "-").alias("slug"),
        F.col("p.product_id").alias("product_id"),
        F.col("p.name").alias("name"),
        F.coalesce("p.min_product_price", "p.price").alias("price"),
        F.transform("p.images", lambda i: i["url"]).alias("images"),
    )
    return one.groupBy("slug", "product_id").agg(F.min_by(F.struct("url", "name", "price", "images"), F.struct("url", "pos")).alias("r")).select("slug", "product_id", "r.*")


def listing_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """Total and page count of a listing: the first positive count, 20 a page, 200 pages at most."""
    state = F.regexp_extract(html, r"(?s)<script id=\"__STATE__\"[^>]*>(.*?)</script>", 1)
    keys = ("listing", "shopListing", "searchListing", "collectionListing", "catalogListing")
    counts = [F.nullif(F.get_json_object(state, f"$.{k}.productsCount").cast("int"), F.lit(0)) for k in keys]
    total = F.coalesce(*(F.when(c > 0, c) for c in counts), F.lit(0))
    return df.select("url", total.alias("total"), F.ceil(F.least(total, F.lit(4000)) / 20).cast("int").alias("pages"))
