"""Whole product records out of stored pages: embedded state, then JSON-LD, then patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scores import let
from opsframe.functions.text import clean_ws, hires_image, spec_value, squeeze, strip_html
from opsframe.operators.pages import BOILERPLATE, TEXT_BLOCK, first_tag, meta
from opsframe.sources.readers import parse_gateway

# Labels of 1 to 60 characters and values of 1 to 300 in neighbouring cells, and the script of a page's state.
DIV_PAIR = r"<div[^>]*>([^<]{1,60})</div>\s*<div[^>]*>([^<]{1,300})</div>"
ROW_PAIR = r"<(?:dt|th|li)[^>]*>([^<]{1,60})</(?:dt|th|li)>\s*<(?:dd|td)[^>]*>([^<]{1,300})</(?:dd|td)>"
STATE = r"(?s)<script[^>]*__NEXT_DATA__[^>]*>\s*(.*?)\s*</script>"


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _pairs(html: Column, pattern: str) -> Column:
    cells = F.zip_with(F.regexp_extract_all(html, F.lit(pattern), 1), F.regexp_extract_all(html, F.lit(pattern), 2), lambda k, v: F.struct(clean_ws(k).alias("k"), clean_ws(v).alias("v")))
    return F.filter(cells, lambda p: F.length(p["k"]).between(2, 59) & (p["v"] != "") & (p["k"] != p["v"]) & ~p["k"].startswith("₹") & ~p["v"].startswith("₹"))


def _last_of_each(pairs: Column) -> Column:
    """A map of the last value of each label; null for no pair."""
    last = let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"])))
    return let(last, lambda ps: F.when(F.size(ps) > 0, F.map_from_entries(ps)))


def grid_specs(html: Column) -> Column:
    """Specs of neighbouring divs; if there are none, of items or heads followed by a cell. The last of a repeated label; null for none."""
    return _last_of_each(let(_pairs(html, DIV_PAIR), lambda ps: F.when(F.size(ps) > 0, ps).otherwise(_pairs(html, ROW_PAIR))))


def image_list(html: Column, most: int = 10) -> Column:
    """Large images of scripts, keys of the image attribute's JSON, then the main image: full-size forms, distinct, no gif or sprite, `most` of them."""
    large = F.regexp_extract_all(html, F.lit(r'"hiRes"\s*:\s*"(https?://[^"]+)"'), 1)
    attribute = F.replace(F.regexp_extract(html, r'(?s)data-a-dynamic-image="(\{.*?\})"', 1), F.lit("&quot;"), F.lit('"'))
    keys = F.coalesce(F.json_object_keys(attribute), F.array().cast("array<string>"))
    main = F.regexp_extract_all(html, F.lit(r'id="landingImage"[^>]*src="([^"]+)"'), 1)
    urls = F.transform(F.concat(large, keys, F.slice(main, 1, 1)), lambda u: F.replace(F.trim(u), F.lit("\\/"), F.lit("/")))
    kept = F.filter(urls, lambda u: (u != "") & ~u.endswith(".gif") & ~F.contains(u, F.lit("sprite")))
    return F.slice(F.array_distinct(F.transform(kept, hires_image)), 1, most)


def _state(state: Column) -> Column:
    """title, description, price, product_id, images, specs of a page's state in the plain or the nested form; null title if it holds no product."""
    # let: a nullif writes its argument out twice
    at = lambda path: let(F.get_json_object(state, path), lambda x: F.when((x != "") & (x != "{}"), x))
    props = "$.props.pageProps"
    plain = F.coalesce(at(f"{props}.productData"), at(f"{props}.product"), at(f"{props}.data"))
    nested = at(f"{props}.initialState.product.details.data")

    def form(body: Column, rupees: bool) -> Column:
        one = lambda path: let(F.get_json_object(body, path), lambda x: F.when(x != "", x))
        none = F.array().cast("array<string>")
        attributes = [F.coalesce(F.from_json(one(f"$.product_details.{part}.attributes"), "array<struct<field_name:string,value:string>>"), F.array().cast("array<struct<field_name:string,value:string>>")) for part in ("product_highlights", "additional_details")]
        pairs = F.transform(F.filter(F.concat(*attributes), lambda a: (a["field_name"] != "") & (a["value"] != "")), lambda a: F.struct(a["field_name"].alias("k"), a["value"].alias("v")))
        title = one("$.name") if rupees else F.coalesce(one("$.title"), one("$.name"))

        def record(x: Column) -> Column:
            price, images = F.when(x["price"] != "0", x["price"]), x["images"]
            # a nested product with neither price nor image is one that's gone
            there = (price.isNotNull() | (F.size(F.coalesce(images, none)) > 0)) if rupees else F.lit(True)
            return F.struct(
                F.when(there, clean_ws(F.substring(title, 1, 500))).alias("title"),
                F.substring(strip_html(one("$.description")), 1, 5000 if rupees else 2000).alias("description"),
                (F.concat(F.lit("₹"), price) if rupees else price).alias("price"),
                one("$.product_id").alias("product_id"),
                F.slice(images, 1, 10).alias("images"),
                _last_of_each(pairs).alias("specs"),
            )

        return let(F.struct(one("$.price").alias("price"), F.from_json(one("$.images"), "array<string>").alias("images")), record)

    bodies = F.struct(plain.alias("plain"), nested.alias("nested"))
    return let(bodies, lambda b: F.when(b["plain"].isNotNull(), form(b["plain"], False)).when(b["nested"].isNotNull(), form(b["nested"], True)))


def state_products(pages: DataFrame, html: str = "html") -> DataFrame:
    """url, product_id, title, description, price, images, specs of each page whose state holds a product, in the plain or the nested form.

    Pages without a state, with broken JSON or without a product's name have no row.
    """
    # exploded, not filtered: a filter would be pushed down and work the state out once more for each use of it
    state = let(F.regexp_extract(html, STATE, 1), _state)
    named = F.filter(F.array(state), lambda s: _filled(s["title"]).isNotNull())
    return pages.select("url", F.explode(named).alias("s")).select("url", "s.product_id", "s.title", "s.description", "s.price", "s.images", "s.specs")


def stream_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """url, price, mrp_price, category, brand of the first pushed script block that names product details; no row for other pages."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?s)self\.__next_f\.push\(\[1,"(.*?)"\]\)'), 1)
    block = F.try_element_at(F.filter(blocks, lambda b: F.contains(b, F.lit("productDetails"))), F.lit(1))
    # a block is the inside of a JSON string
    text = F.get_json_object(F.concat(F.lit('{"t":"'), block, F.lit('"}')), "$.t")
    details = F.nullif(F.regexp_extract(text, r'(?s)"productDetails":(.*)', 1), F.lit(""))
    bodies = pages.select(F.col("url").alias("id"), details.alias("d")).where("d is not null")
    bodies = bodies.select("id", F.coalesce(F.get_json_object("d", "$.data"), F.get_json_object("d", "$")).alias("body")).where("body is not null")
    return parse_gateway(bodies).withColumnRenamed("id", "url")


def _json_ld(html: Column) -> Column:
    """name, description, price, images of the first script whose product has a name."""
    kind = "struct<`@type`:string,name:string,description:string,image:string,offers:struct<price:string>>"
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>\s*(.*?)\s*</script>"), 1)
    items = lambda b: F.when(b.startswith("["), F.from_json(b, f"array<{kind}>")).otherwise(F.coalesce(F.from_json(F.get_json_object(b, "$['@graph']"), f"array<{kind}>"), F.array(F.from_json(b, kind))))
    named = F.filter(F.flatten(F.filter(F.transform(scripts, items), lambda x: x.isNotNull())), lambda p: p["name"].isNotNull() & F.coalesce(p["@type"] == "Product", F.lit(True)))
    return F.try_element_at(named, F.lit(1))


def _long_text(html: Column) -> Column:
    """Texts of 100 to 5000 characters that say something, the first of each 50-character start, joined."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(TEXT_BLOCK), 1), squeeze)
    good = F.filter(blocks, lambda t: (F.length(t) > 100) & (F.length(t) < 5000) & ~t.rlike("^[₹0-9]"))
    first = let(good, lambda ts: F.filter(ts, lambda t, i: ~F.exists(F.slice(ts, 1, i), lambda u: F.substring(u, 1, 50) == F.substring(t, 1, 50))))
    return F.array_join(F.filter(first, lambda t: ~F.lower(t).rlike("|".join(BOILERPLATE))), " ")


def extract_products(pages: DataFrame, html: str = "html") -> DataFrame:
    """url, status, title, description, meta_description, images, price, dimensions, weight, gst, hsn, specifications: one row a page.

    The state's product comes first, then the JSON-LD one, then the page's h1 and first rupee price; all of
    a record's price and images are of the same origin. The description is the record's or, if longer, the page's
    long texts, else the meta one. Pages without a title and null pages are blocked. Repeated rows each get a row.
    """
    page = F.col("html")
    read = pages.select("url", F.coalesce(F.col(html), F.lit("")).alias("html"))
    read = read.select("url", "html", let(F.regexp_extract(page, STATE, 1), _state).alias("s"), _json_ld(page).alias("ld"), grid_specs(page).alias("grid"), _long_text(page).alias("long"))
    by_state, by_ld = _filled(F.col("s.title")).isNotNull(), F.col("ld.name").isNotNull()
    pick = lambda state, ld, other: F.when(by_state, state).when(by_ld, ld).otherwise(other)
    shown = F.regexp_extract(page, r"₹\s*([\d,]+(?:\.\d{2})?)", 1)
    none = F.lit(None).cast("string")
    own = pick(F.col("s.description"), F.col("ld.description"), none)
    records = read.select(
        "url",
        pick(F.col("s.title"), squeeze(F.substring(F.col("ld.name"), 1, 500)), squeeze(F.substring(first_tag(page, "h1"), 1, 500))).alias("title"),
        F.when(F.length("long") > F.length(F.coalesce(own, F.lit(""))), F.col("long")).otherwise(_filled(own)).alias("own"),
        F.coalesce(_filled(own), meta(page, "description")).alias("meta_description"),
        pick(F.col("s.images"), F.array_compact(F.array("ld.image")), image_list(page)).alias("images"),
        pick(F.col("s.price"), F.col("ld.offers.price"), F.when(shown != "", F.concat(F.lit("₹"), shown))).alias("price"),
        F.coalesce(F.when(by_state, F.col("s.specs")), F.col("grid")).alias("specifications"),
    )
    spec = lambda part: spec_value(F.col("specifications"), (part,), False)
    return records.select(
        "url",
        F.when(_filled(F.col("title")).isNull(), "blocked").otherwise("success").alias("status"),
        _filled(F.col("title")).alias("title"),
        F.coalesce("own", "meta_description").alias("description"),
        "meta_description",
        F.coalesce("images", F.array().cast("array<string>")).alias("images"),
        "price",
        F.coalesce(spec("dimension"), spec("size")).alias("dimensions"),
        spec("weight").alias("weight"),
        F.coalesce(spec("gst"), spec("tax")).alias("gst"),
        spec("hsn").alias("hsn"),
        "specifications",
    )


def wide_records(records: DataFrame, code: Column, platform: str) -> DataFrame:
    """The fixed wide record of each extracted one: placeholder title and error, and nothing else, where it isn't a success; first image as main image."""
    good = F.col("status") == "success"
    blank = F.when(F.col("status") == "blocked", f"Blocked by {platform}").otherwise("Failed to scrape")
    texts = ["description", "meta_description", "hsn", "gst", "dimensions", "weight", "specifications", "price"]
    return records.select(
        code.alias("id"),
        F.when(good, F.coalesce(_filled(F.col("title")), F.lit("Untitled Product"))).otherwise(blank).alias("title"),
        F.when(good, F.get("images", F.lit(0))).alias("image_url"),
        F.when(good, F.col("images")).otherwise(F.array().cast("array<string>")).alias("images"),
        *(F.when(good, F.col(c)).alias(c) for c in texts),
        F.lit(None).cast("string").alias("variants"),
        "url",
        F.coalesce("status", F.lit("failed")).alias("status"),
        F.when(~F.coalesce(good, F.lit(False)), F.when(F.col("status") == "blocked", f"Request blocked by {platform}").otherwise("Scraping failed")).alias("error"),
    )
