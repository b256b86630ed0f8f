"""Page extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions import text as T
from opsframe.operators import pages as P
from opsframe.operators.monitoring import attach_recording, evaluate_checks, substep_status
from opsframe.sources import readers
from opsframe.sources.adapters import view, with_views
from opsframe.sources.readers import scan


def _pages(s, d):
    return scan(s, d, "pages")


def _product_pages(s, d):
    """Pages with JSON-LD, specs and a listing state, made of the parts."""
    # dealt before the pages are made: a small file of parts would be one task
    p = view(s, d, "products_v").repartition("id")
    ld = F.format_string('<script type="application/ld+json">{"@type":"Product","name":"%s","category":"%s","brand":{"name":"%s"},"offers":{"price":"%s"}}</script>', "name", F.coalesce("category", F.lit("none")), F.coalesce("brand", F.lit("none")), F.coalesce("price", F.lit("0")))
    graph = F.format_string('<script type="application/ld+json">{"@graph":[{"@type":"WebPage","name":"x"},{"@type":"Product","name":"%s"}]}</script>', "name")
    specs = F.format_string("<table><tr><th>Weight</th><td>%d g</td></tr><tr><th>Dimensions</th><td>%d x 2 x 3 cm; %d kg</td></tr>%s</table><ul><li><b>Item weight:</b> 9 kg</li></ul>", F.col("num").cast("int"), (F.col("num") % 90).cast("int"), (F.col("num") % 9).cast("int"), F.when(F.col("num") % 4 == 0, "<tr><th>A size</th><td>no</td></tr><tr><th>Size</th><td>large; boxed</td></tr>").when(F.col("num") % 4 == 1, "<tr><th>GST rate</th><td>18%</td></tr><tr><th>HSN code</th><td>9403</td></tr>").otherwise(""))
    state = F.format_string('<script id="__STATE__">{"listing":{"productsCount":%d,"pages":[{"products":[{"slug":"A b%d","product_id":"%d","name":"%s","price":5},{"slug":"A b%d","product_id":"%d","name":"again","price":6}]}]}}</script>', (F.col("num") * 3).cast("int"), F.col("num").cast("int"), F.col("num").cast("int"), "name", F.col("num").cast("int"), F.col("num").cast("int"))
    return p.select("id", "num", "url", F.concat(F.lit("<html>"), F.when(F.col("num") % 2 == 0, ld).otherwise(graph), specs, state).alias("html"))


def _steps(s, d):
    seq = F.col("p_partkey")
    return scan(s, d, "part").select(
        seq.alias("seq"),
        F.concat(F.when(seq % 3 == 0, "mweb_").when(seq % 3 == 1, "web_").otherwise(""), F.lower("p_type")).alias("step"),
        F.when(seq % 4 == 3, F.concat(F.lit("video-"), seq)).alias("video_path"),
        F.array(F.struct(F.when(seq % 5 == 0, "fail").otherwise("pass").alias("status")), F.struct(F.lit("pass").alias("status"))).alias("sub_steps"),
    )


_HOST = "regexp_extract(lower(url), '^https?://([^/:?#]+)', 1)"
_BLOCKED = "length(html) < {n} OR contains(html, 'sec-if-cpt-container') OR contains(html, 'Access Denied') OR contains(html, 'cf-browser-verification') OR contains(substr(html, 1, 2000), '_abck') OR contains(substr(html, 1, 2000), '/cdn-cgi/')"


def _tag(t: str) -> str:
    return f"NULLIF(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{t}\\b[^>]*>(.*?)</{t}>', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), '')"


Q = {
    "s5_pages": (lambda s, d: _pages(s, d).select("page_id", "url", F.length("html").cast("long").alias("n")), "SELECT page_id, url, length(html) AS n FROM pages"),
    "s6_explode_listing": (
        lambda s, d: readers.explode_listing(_product_pages(s, d)).select("slug", "product_id", "name", "price", "url"),
        "SELECT concat('a-b', CAST(num AS VARCHAR)) AS slug, CAST(num AS VARCHAR) AS product_id, name, 5.0::DOUBLE AS price, url FROM products_v",
    ),
    "s7_listing_pages": (
        lambda s, d: readers.listing_pages(_product_pages(s, d)),
        "SELECT url, CAST(num * 3 AS INTEGER) AS total, CAST(ceil(least(num * 3, 4000) / 20.0) AS INTEGER) AS pages FROM products_v",
    ),
    "f6_allowed_host": (
        lambda s, d: _pages(s, d).select("page_id", T.allowed_host(F.col("url"), ["example.com"]).alias("allowed")),
        f"SELECT page_id, regexp_matches({_HOST}, '(^|[.])example[.]com$') AS allowed FROM pages",
    ),
    "f7_platform_of": (
        lambda s, d: view(s, d, "mappings_v").select("product_id", T.platform_of(F.coalesce("flipkart_url", "amazon_url")).alias("platform")),
        "SELECT product_id, CASE WHEN flipkart_url IS NOT NULL THEN 'flipkart' WHEN amazon_url IS NOT NULL THEN 'amazon' END AS platform FROM mappings_v",
    ),
    "f8_is_blocked_page": (lambda s, d: _pages(s, d).select("page_id", T.is_blocked_page(F.col("html"), 1000).alias("blocked")), f"SELECT page_id, {_BLOCKED.format(n=1000)} AS blocked FROM pages"),
    "f9_blocked_url": (lambda s, d: _pages(s, d).select("page_id", T.blocked_url(F.concat("url", F.when(F.col("page_id") % 4 == 0, "/Captcha").otherwise(""))).alias("blocked")), "SELECT page_id, page_id % 4 = 0 OR regexp_matches(lower(url), 'captcha|challenge|blocked|sorry') AS blocked FROM pages"),
    "f15_evaluate_checks": (
        lambda s, d: evaluate_checks(_pages(s, d).select("page_id", F.when(F.col("page_id") % 2 == 0, "count").otherwise("text").alias("check_type"), F.lit(True).alias("visible"), F.size(F.split("html", "<li>")).alias("match_count"), F.lit(10).alias("min"), F.col("html").alias("text"), F.lit("").alias("attr"), F.lit("the").alias("expected"))).select("page_id", "status"),
        "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CASE WHEN len(string_split(html, '<li>')) >= 10 THEN 'pass' ELSE 'fail' END WHEN contains(html, 'the') THEN 'pass' ELSE 'fail' END AS status FROM pages",
    ),
    "f17_search_records": (lambda s, d: _pages(s, d).where(F.contains(F.lower("url"), F.lit("page=2"))).select("page_id", "url"), "SELECT page_id, url FROM pages WHERE contains(lower(url), 'page=2')"),
    "n2_spec_pairs": (
        lambda s, d: P.spec_pairs(_product_pages(s, d)).select("url", T.spec_value(F.col("specs"), ("dimension",)).alias("dimensions"), F.size("specs").cast("long").alias("n")),
        "SELECT url, concat(CAST(num % 90 AS VARCHAR), ' x 2 x 3 cm; ', CAST(num % 9 AS VARCHAR), ' kg') AS dimensions, CASE WHEN num % 4 < 2 THEN 5 ELSE 3 END::BIGINT AS n FROM products_v",
    ),
    "n1_spec_derive": (
        lambda s, d: P.spec_pairs(_product_pages(s, d)).select("url", T.spec_derive(F.col("specs")).alias("a"), T.spec_derive(F.col("specs"), False).alias("b")).select("url", F.col("a.weight").alias("first"), F.col("b.weight").alias("last"), F.col("a.dimensions").alias("size"), F.col("b.dimensions").alias("whole"), F.col("a.gst").alias("gst"), F.col("b.hsn").alias("hsn")),
        "SELECT url, concat(CAST(num AS VARCHAR), ' g') AS first, '9 kg' AS last, concat(CAST(num % 90 AS VARCHAR), ' x 2 x 3 cm') AS size, CASE WHEN num % 4 = 0 THEN 'large; boxed' ELSE concat(CAST(num % 90 AS VARCHAR), ' x 2 x 3 cm; ', CAST(num % 9 AS VARCHAR), ' kg') END AS whole, CASE WHEN num % 4 = 1 THEN '18%' END AS gst, CASE WHEN num % 4 = 1 THEN '9403' END AS hsn FROM products_v",
    ),
    "n3_json_ld": (
        lambda s, d: P.json_ld_products(_product_pages(s, d)),
        "SELECT url, name, CASE WHEN num % 2 = 0 THEN coalesce(brand, 'none') END AS brand, CASE WHEN num % 2 = 0 THEN coalesce(category, 'none') END AS category, CASE WHEN num % 2 = 0 THEN coalesce(price, '0') END AS price FROM products_v",
    ),
    "n5_page_records": (
        lambda s, d: P.page_records(_pages(s, d)),
        f"SELECT page_id, url, coalesce({_tag('h1')}, {_tag('title')}) AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links, CASE WHEN {_BLOCKED.format(n=1000)} THEN 'blocked' WHEN coalesce({_tag('h1')}, {_tag('title')}) IS NULL THEN 'failed' ELSE 'success' END AS status FROM pages",
    ),
    "n6_image_list": (
        lambda s, d: view(s, d, "products_v").select("id", F.size(F.slice(F.array_distinct(F.filter(F.transform(F.array("image_url", F.concat("image_url", F.lit("?x=1")), F.lit("a.gif")), T.full_size_image), lambda u: u.isNotNull() & ~u.rlike("[.]gif|sprite"))), 1, 10)).cast("long").alias("n")),
        "SELECT id, CASE WHEN image_url IS NULL THEN 0 ELSE 1 END AS n FROM products_v",
    ),
    "t6_full_size_image": (lambda s, d: view(s, d, "products_v").select("id", T.full_size_image(F.replace("image_url", F.lit(".jpg"), F.lit("_512.jpg?w=2"))).alias("u")), "SELECT id, image_url AS u FROM products_v"),
    "t7_strip_html": (lambda s, d: view(s, d, "products_v").select("id", T.strip_html(F.concat(F.lit("<p>a<br/>"), "name", F.lit("</p>\n \n<i>b</i>"))).alias("text")), "SELECT id, concat('a', chr(10), name, chr(10), 'b') AS text FROM products_v"),
    "t10_extract_domain": (lambda s, d: _pages(s, d).select("page_id", T.extract_domain(F.col("url")).alias("domain")), "SELECT page_id, regexp_extract(lower(url), '^https?://(?:www\\.)?([^/:?#]+)', 1) AS domain FROM pages"),
    "t11_extract_dimensions": (
        lambda s, d: scan(s, d, "part").select("p_partkey", T.extract_dimensions(F.concat(F.when(F.col("p_partkey") % 2 == 0, "size: ").otherwise("about "), "p_size", F.lit(",5 x 4"), F.when(F.col("p_partkey") % 3 == 0, " x 7 cm").otherwise(""))).alias("dims")),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat(CAST(p_size AS VARCHAR), '.5 x 4 x 7') WHEN p_partkey % 2 = 0 THEN concat(CAST(p_size AS VARCHAR), '.5 x 4') END AS dims FROM part",
    ),
    "n11_record_normalise": (
        lambda s, d: P.page_records(_pages(s, d)).select("page_id", F.when(F.col("status") == "success", F.col("title")).otherwise(F.concat(F.lit("Untitled "), F.upper("status"))).alias("title")),
        f"SELECT page_id, CASE WHEN {_BLOCKED.format(n=1000)} THEN 'Untitled BLOCKED' ELSE coalesce({_tag('h1')}, {_tag('title')}, 'Untitled FAILED') END AS title FROM pages",
    ),
    "k7_wide_export": (
        lambda s, d: P.wide_export(view(s, d, "products_v").select("id", F.array_compact(F.array("image_url", F.when(F.col("num") % 3 == 0, F.col("url")))).alias("images"), F.create_map(F.lit("k"), F.coalesce("brand", F.lit("-")), F.lit("a"), F.lit("b")).alias("specifications"))),
        "SELECT id, coalesce(image_url, CASE WHEN num % 3 = 0 THEN url END) AS \"Image 1\", CASE WHEN image_url IS NOT NULL AND num % 3 = 0 THEN url END AS \"Image 2\", concat('a: b', chr(10), 'k: ', coalesce(brand, '-')) AS specs_text FROM products_v",
    ),
    "k9_write_back": (
        lambda s, d: P.write_back(view(s, d, "products_v").select("id", F.col("name").alias("title"), "price"), view(s, d, "products_v").where("num % 3 = 0").select("id", F.upper("name").alias("Title"), F.lit("success").alias("Status")), "id", ["Title", "Status"]),
        "SELECT id, CASE WHEN num % 3 = 0 THEN upper(name) ELSE name END AS title, price, CASE WHEN num % 3 = 0 THEN 'success' END AS Status FROM products_v",
    ),
    "a14_detect_url_column": (
        lambda s, d: P.detect_url_column(view(s, d, "products_v").select("id", "name", "image_url", "url"), ["shop.example"]),
        "SELECT 'url' AS \"column\", count(url) AS n FROM products_v",
    ),
    "a18_substep_status": (lambda s, d: substep_status(_steps(s, d)).select("seq", "status"), "SELECT p_partkey AS seq, CASE WHEN p_partkey % 5 = 0 THEN 'degraded' ELSE 'pass' END AS status FROM part"),
    "j15_attach_recording": (
        lambda s, d: attach_recording(_steps(s, d)).select("seq", "platform", "recording"),
        "WITH st AS (SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'mweb' WHEN 1 THEN 'web' END AS platform, CASE WHEN p_partkey % 4 = 3 THEN concat('video-', CAST(p_partkey AS VARCHAR)) END AS v FROM part) SELECT seq, st.platform, r.v AS recording FROM st LEFT JOIN (SELECT platform, arg_min(v, seq) AS v FROM st WHERE v IS NOT NULL GROUP BY platform) r ON st.platform = r.platform",
    ),
}


def queries() -> dict:
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: with_views(sql) for k, (_, sql) in Q.items() if sql}
