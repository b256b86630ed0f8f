"""Product records out of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scores import let
from opsframe.functions.text import is_blocked_page, squeeze, strip_html
from opsframe.operators.keyed import first_per_key


def first_tag(html: Column, tag: str) -> Column:
    return F.nullif(squeeze(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", "")), F.lit(""))


def meta(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"(?is)<meta[^>]+(?:name|property)=\"{name}\"[^>]+content=\"([^\"]*)\"", 1), F.lit(""))


def json_ld_products(pages: DataFrame, html: str = "html") -> DataFrame:
    """url, name, brand, category, price of the first JSON-LD product of a page: a bare one, in a list, or in a @graph."""
    kind = "struct<`@type`:string,name:string,category:string,brand:struct<name:string>,offers:struct<price:string>>"
    scripts = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), 1)
    s = pages.select("url", F.posexplode(scripts).alias("pos", "body"))
    body = F.trim("body")
    items = F.when(body.startswith("["), F.from_json(body, f"array<{kind}>")).otherwise(F.coalesce(F.from_json(F.get_json_object(body, "$['@graph']"), f"array<{kind}>"), F.array(F.from_json(body, kind))))
    found = s.select("url", "pos", F.posexplode(items).alias("at", "p")).where("p.name is not null and (p.`@type` = 'Product' or p.`@type` is null)")
    flat = found.select("url", "pos", "at", F.col("p.name").alias("name"), F.col("p.brand.name").alias("brand"), F.col("p.category").alias("category"), F.col("p.offers.price").alias("price"))
    return first_per_key(flat, ["url"], ["pos", "at"]).drop("pos", "at")


def spec_pairs(pages: DataFrame, html: str = "html") -> DataFrame:
    """url, specs: th/td, dt/dd and bold-bullet pairs in page order, the first of a repeated key."""
    pair = r"(?is)<(?:th|dt)[^>]*>(.*?)</(?:th|dt)>\s*<(?:td|dd)[^>]*>(.*?)</(?:td|dd)>"
    bullet = r"(?is)<li[^>]*>\s*<(?:b|strong)>(.*?):?</(?:b|strong)>\s*:?(.*?)</li>"
    rows = lambda p: F.zip_with(F.regexp_extract_all(html, F.lit(p), 1), F.regexp_extract_all(html, F.lit(p), 2), lambda k, v: F.struct(squeeze(strip_html(k)).alias("k"), squeeze(strip_html(v)).alias("v")))
    kept = F.filter(F.transform(F.concat(rows(pair), rows(bullet)), lambda e, i: F.struct(i.alias("pos"), e["k"].alias("k"), e["v"].alias("v"))), lambda e: F.length(e["k"]).between(1, 60) & F.length(e["v"]).between(1, 500) & ~F.contains(e["v"], F.lit("₹")))
    first = lambda ps: F.filter(ps, lambda e, i: ~F.exists(F.slice(ps, 1, i), lambda f: f["k"] == e["k"]))
    # the pairs of a page stay in its row; pages of one url come together as rows of few bytes
    each = pages.select("url", F.explode(F.filter(F.array(let(kept, first)), lambda ps: F.size(ps) > 0)).alias("ps"))
    whole = each.groupBy("url").agg(F.collect_list("ps").alias("pages")).select("url", let(F.array_sort(F.flatten("pages")), first).alias("ps"))
    return whole.select("url", F.map_from_entries(F.transform("ps", lambda e: F.struct(e["k"], e["v"]))).alias("specs"))


# Phrases of texts that say nothing about a product.
BOILERPLATE = [
    "color of the product may vary",
    "picture displayed",
    "product's dimensions",
    "fit through the entrance",
    "civil work",
    "drilling holes",
    "wiping the surface",
    "assembly is required",
]
TEXT_BLOCK = r"(?is)<(?:p|li|div)[^>]*>([^<]+)</(?:p|li|div)>"


def long_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, pos, text: paragraphs and items of 100 to 5000 characters, first of each 50-character start, without boilerplate."""
    blocks = F.regexp_extract_all(html, F.lit(TEXT_BLOCK), 1)
    each = pages.select("page_id", F.posexplode(F.transform(blocks, squeeze)).alias("pos", "text"))
    good = each.where((F.length("text") > 100) & (F.length("text") < 5000) & ~F.col("text").rlike("^[₹0-9]"))
    first = first_per_key(good.withColumn("start", F.substring("text", 1, 50)), ["page_id", "start"], ["pos"])
    return first.where(~F.lower("text").rlike("|".join(BOILERPLATE))).select("page_id", "pos", "text")


def search_records(records: DataFrame, query: str) -> DataFrame:
    """Records whose title or url holds the query, in any case."""
    q = F.lit(query.lower())
    return records.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), q) | F.contains(F.lower(F.coalesce("url", F.lit(""))), q))


def outcome_counts(records: DataFrame) -> DataFrame:
    """n, n_success, n_failed, n_blocked of a run, in one row."""
    return records.agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("success", "failed", "blocked")))


def page_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, title, n_links, status: h1, else title tag; blocked pages and pages without a title are told apart."""
    title = F.coalesce(first_tag(F.col("html"), "h1"), first_tag(F.col("html"), "title"))
    status = F.when(is_blocked_page(F.col("html"), least), "blocked").when(title.isNull(), "failed").otherwise("success")
    return pages.select("page_id", "url", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"<a href=\"([^\"]*)\""), 1)).cast("long").alias("n_links"), status.alias("status"))


def wide_export(records: DataFrame, images: str = "images", specs: str = "specifications", most: int = 50) -> DataFrame:
    """Image 1..N columns, N the most images of a record (one at least, `most` at most), and specs as `k: v` lines.

    A record with more than `most` images has the others as lines of the last column, so that one broken page makes no
    column of each of its images and none is lost.
    """
    n = min(max(1, records.agg(F.max(F.size(images))).first()[0] or 1), most)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(specs)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    one = [F.get(images, F.lit(i)).alias(f"Image {i + 1}") for i in range(n - 1)]
    rest = F.nullif(F.array_join(F.slice(images, n, F.greatest(F.size(images), F.lit(1))), "\n"), F.lit("")).alias(f"Image {n}")
    return records.select("*", *one, rest, text.alias("specs_text")).drop(images, specs)


def detect_url_column(sheet: DataFrame, marks: list[str]) -> DataFrame:
    """column, n: the column with most URL-like cells, the first of equals; null if no cell is."""
    hit = lambda c: F.coalesce(F.lower(F.col(f"`{c}`")).rlike("^https?://|" + "|".join(m.replace(".", "[.]") for m in marks)), F.lit(False))
    counts = sheet.agg(*(F.count_if(hit(c)).alias(c) for c in sheet.columns))
    pairs = F.array(*(F.struct(F.col(f"`{c}`").alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("column")) for i, c in enumerate(sheet.columns)))
    best = counts.select(F.array_max(pairs).alias("b"))
    return best.select(F.when(F.col("b.n") > 0, F.col("b.column")).alias("column"), F.col("b.n").alias("n"))


def write_back(sheet: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Results onto the sheet by row position; existing columns match case-insensitively, rows without a result stay."""
    by_name = {c.lower(): c for c in sheet.columns}
    r = results.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    j = sheet.join(r, key, "left")
    out = {by_name.get(c.lower(), c): F.coalesce(F.col(f"__{c}"), F.col(by_name[c.lower()]) if c.lower() in by_name else F.lit(None).cast("string")) for c in columns}
    return j.withColumns(out).drop(*(f"__{c}" for c in columns))


# Keys that products of a page's state have their parts under, the usual one first.
STATE_KEYS = {"product_id": ("productId", "product_id", "id"), "name": ("name", "title", "productName"), "price": ("price", "sellingPrice", "min_product_price")}


def _state_part(v: Column, names: tuple[str, ...]) -> Column:
    """The first of an object's values that is a number or a text that is not empty, as text."""

    def plain(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$['{name}']", "variant"))
        return F.when(kind.rlike("^(STRING|[A-Z]*INT|DECIMAL|DOUBLE|FLOAT)"), F.nullif(F.try_variant_get(v, f"$['{name}']", "string"), F.lit("")))

    return F.coalesce(*map(plain, names))


def deep_state_products(pages: DataFrame, html: str = "html", depth: int = 25) -> DataFrame:
    """url, product_id, name, price of every product object in the embedded state, at any depth up to `depth`.

    A product has an id and a name under one of their usual keys. A state is parsed once and opened level by level within
    its row: all objects and lists of a level give the next one, until a level has none. Nothing is shuffled or stored, so
    the work is one pass over the pages; a row holds two levels of its state and its products. Broken states have no products.
    """
    state = F.regexp_extract(html, r"(?s)<script id=\"__STATE__\"[^>]*>(.*?)</script>", 1)
    parts = "product_id string, name string, price string"
    kind = f"struct<level:array<variant>,found:array<struct<{parts.replace(' string', ':string')}>>>"
    none = F.array().cast("array<variant>")

    def inside(v: Column) -> Column:
        """The objects and lists that an object or a list holds, in it."""
        values = F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>"), none)
        return F.filter(values, nested)

    def nested(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(False))

    def opened(acc: Column, _: Column) -> Column:
        here = F.transform(acc["level"], lambda v: F.struct(*(_state_part(v, names).alias(part) for part, names in STATE_KEYS.items())))
        products = F.filter(here, lambda p: p["product_id"].isNotNull() & p["name"].isNotNull())
        return F.when(F.size(acc["level"]) == 0, acc).otherwise(F.struct(F.flatten(F.transform(acc["level"], inside)).alias("level"), F.concat(acc["found"], products).alias("found")).cast(kind))

    top = F.filter(F.array(F.try_parse_json(F.nullif(state, F.lit("")))), nested)
    begun = F.struct(top.alias("level"), F.array().cast(f"array<struct<{parts.replace(' string', ':string')}>>").alias("found")).cast(kind)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), begun, opened)["found"]
    return pages.select("url", F.explode(found).alias("p")).select("url", "p.*")
