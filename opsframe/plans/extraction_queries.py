"""Queries of whole records out of pages in several shapes, broken ones among them, and of what goes with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions import text as T
from opsframe.operators import catalog as C
from opsframe.operators import extraction as E
from opsframe.operators import monitoring as M
from opsframe.operators import pages as P
from opsframe.operators import videos as V
from opsframe.plans.matching_queries import _REL
from opsframe.plans.monitoring_queries import _FLOWS
from opsframe.sources.adapters import view, with_views
from opsframe.sources.readers import scan


def _shaped(s, d):
    """A page of each part: plain state, nested state, JSON-LD, patterns, nothing, broken state over patterns, a nested product that's gone."""
    num, name = F.col("num").cast("bigint"), F.col("name")
    state = lambda body: F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":'), body, F.lit("}}</script>"))
    nested = F.format_string('{"initialState":{"product":{"details":{"data":{"name":"%s","product_id":%d,"price":%d,"description":"<b>Sold</b><br/>as is","images":["https://cdn.shop.example/a_512.jpg"],"product_details":{"product_highlights":{"attributes":[{"field_name":"Net Weight","value":"1 g"},{"field_name":"Size","value":"%d cm"}]},"additional_details":{"attributes":[{"field_name":"Net Weight","value":"%d g"},{"field_name":"","value":"x"}]}}}}}}}', name, num, num + 5, num % 90, num)
    gone = F.format_string('{"initialState":{"product":{"details":{"data":{"name":"%s","product_id":1,"price":0}}}}}', name)
    grid = F.format_string("<div>Weight</div><div>old</div><div>Weight</div> <div>%d kg</div><div>₹5</div><div>x</div>", num)
    rows = F.format_string("<dl><dt>GST rate</dt><dd>5%%</dd><dt>HSN</dt><dd>%d</dd></dl>", num)
    long = F.concat(F.lit("<p>"), F.repeat(F.concat(name, F.lit(" is a fine thing. ")), 12), F.lit("</p><p>"), F.repeat(F.lit("Color of the product may vary. "), 5), F.lit("</p>"))
    heading = F.format_string("<h1 class='t'><i>%s</i></h1> MRP ₹ %d,000.50", name, num)
    kind = F.col("num") % 7
    body = (
        F.when(kind == 0, F.concat(state(F.format_string('{"productData":{"title":" %s ","price":%d,"description":"short"}}', name, num)), grid))
        .when(kind == 1, state(nested))
        .when(kind == 2, F.concat(F.format_string('<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type":"Product","name":"%s","description":"by data","offers":{"price":"%d"}}</script>', name, num), rows))
        .when(kind == 3, F.concat(heading, grid, rows))
        .when(kind == 4, F.lit("<html></html>"))
        .when(kind == 5, F.concat(F.lit('<script id="__NEXT_DATA__">{"props":{"pageProps"</script>'), heading, long, F.lit('<meta name="description" content="meta">')))
        .when(F.col("num") % 2 == 0, F.concat(state(gone), heading))
    )
    # dealt before the pages are made: a small file of parts would be one task
    return view(s, d, "products_v").repartition("id").select("id", "num", "name", "url", body.alias("html"))


_SHAPED = """WITH r AS (SELECT *, num % 7 AS k, CAST(num AS VARCHAR) AS t FROM products_v),
x AS (SELECT *, CASE WHEN k = 4 OR (k = 6 AND num % 2 = 1) THEN 'blocked' ELSE 'success' END AS status,
  CASE WHEN k = 0 THEN NULLIF(t, '0') WHEN k = 1 THEN concat('₹', num + 5) WHEN k = 2 THEN t WHEN k IN (3, 5) OR (k = 6 AND num % 2 = 0) THEN concat('₹', t, ',000.50') END AS found,
  CASE k WHEN 0 THEN 'short' WHEN 1 THEN concat('Sold', chr(10), 'as is') WHEN 2 THEN 'by data' WHEN 5 THEN trim(repeat(concat(name, ' is a fine thing. '), 12)) END AS description,
  CASE k WHEN 0 THEN concat(t, ' kg') WHEN 1 THEN concat(t, ' g') WHEN 3 THEN concat(t, ' kg') END AS weight,
  CASE WHEN k = 1 THEN concat(num % 90, ' cm') END AS dimensions, CASE WHEN k = 2 THEN '5%' END AS gst, CASE WHEN k = 2 THEN t END AS hsn FROM r)"""


def _images(s, d):
    """Pages with images in scripts, an attribute and a tag, one of them repeated in another size."""
    num = F.col("num").cast("bigint")
    html = F.concat(
        F.format_string('<script>{"hiRes":"https:\\/\\/m.shop.example\\/I\\/a%d._AC_UL320_.jpg","hiRes" : "https://m.shop.example/I/sprite.png"}</script>', num).cast("string"),
        F.when(num % 3 == 0, F.lit('<img data-a-dynamic-image="{broken}">')).otherwise(F.format_string('<img data-a-dynamic-image="{&quot;https://m.shop.example/I/a%d._SX300_.jpg&quot;:[300,300],&quot;https://m.shop.example/I/b%d.png&quot;:[1,2]}">', num, num)),
        F.when(num % 2 == 0, F.lit('<img id="landingImage" alt="" src="https://m.shop.example/I/c._Xraw.webp">')).otherwise(F.lit('<img id="landingImage" src="https://m.shop.example/I/c.gif">')),
    )
    return view(s, d, "products_v").select("id", F.replace(html, F.lit("https:\\/\\/"), F.lit("https://")).alias("html"))


def _pushed(s, d):
    """Pages whose details are pushed as pieces of a script string."""
    num = F.col("num").cast("bigint")
    details = F.format_string('{\\"price\\":\\"7\\",\\"brandName\\":\\"a \\u0026 b\\",\\"Category\\":[{\\"categoryName\\":\\"%s\\"}],\\"skuList\\":[{\\"isDefault\\":0,\\"price\\":\\"1\\"},{\\"isDefault\\":1,\\"price\\":\\"%d\\",\\"mrpPrice\\":\\"9\\"}]}', F.coalesce("category", F.lit("none")), num)
    inner = F.when(num % 3 == 0, F.concat(F.lit('{\\"data\\":'), details, F.lit("}"))).otherwise(details)
    page = F.concat(F.lit('<script>self.__next_f.push([1,"other \\n"])</script><script>self.__next_f.push([1,"x:{\\"productDetails\\":'), inner, F.lit(',\\"more\\":1}"])</script>'))
    return view(s, d, "products_v").select("url", "num", F.when(num % 5 != 0, page).otherwise("<html>").alias("html"))


def _requests(s, d):
    """A request of each order's lines."""
    item = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("id"), F.when(F.col("l_partkey") % 97 != 0, F.col("l_returnflag")).alias("name"))
    platform = F.when(F.col("l_orderkey") % 4 != 3, "amazon").otherwise("bazaar")
    return scan(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("products"), F.array_distinct(F.collect_set(platform)).alias("platforms"))


def _checkouts(s, d):
    num = F.col("p_partkey")
    step = lambda check, status: F.struct(F.lit(check).alias("check"), status.alias("status"))
    steps = F.array(step("bargain_state", F.when(num % 3 == 0, "degraded").otherwise("pass")), step("pay_button_click", F.when(num % 2 == 0, "pass").otherwise("fail")))
    return scan(s, d, "part").select(num.alias("seq"), F.when(num % 11 != 0, steps).alias("sub_steps"), F.when(num % 7 != 0, num % 5 == 0).alias("gateway"))


def _causes(s, d):
    """Checks with their causes, errors and actions."""
    errors = F.when(F.col("duration_ms") % 2 == 0, F.transform(F.sequence(F.lit(1), F.col("duration_ms") % 5 + 1), lambda i: F.concat(F.repeat(F.lit("e"), 120), i.cast("string"))))
    text = M.cause_text(F.col("page"), F.coalesce("step_failed", F.lit("none")), F.col("status"), errors, F.array("metric", "status"), F.lit(None).cast("array<string>"))
    return view(s, d, "check_results_v").select("seq", text.alias("message"), T.plain_text(text).alias("plain"))


_TEXT = r"""concat('🔍 *RCA: ', page, '*', chr(10), '📋 *Summary:* ', coalesce(step_failed, 'none'), chr(10), '⚠️ *Severity:* ', upper(status), chr(10),
  CASE WHEN duration_ms % 2 = 0 THEN concat('🖥️ *Console Errors (', duration_ms % 5 + 1, '):*', chr(10), repeat(concat('   `', repeat('e', 100), '`', chr(10)), least(3, duration_ms % 5 + 1))) ELSE '' END,
  chr(10), '*🔧 Probable Causes:*', chr(10), '• ', metric, chr(10), '• ', status, chr(10), chr(10), '*✅ Action Items:*')"""
_ICON = "CASE WHEN score < 60 THEN '🔴' WHEN score < 90 THEN '🟡' ELSE '✅' END"
_OVERALL = f"WITH {_FLOWS}, f AS (SELECT *, {{icon}} AS icon FROM flows), o AS (SELECT CAST(round_even(sum(score * total) / sum(total), 0) AS BIGINT) AS overall, sum(total) AS total FROM flows)"


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _contains_any(c: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{m}')" for m in marks) + ")"


_BLOCKS = r"regexp_extract_all(html, '(?is)<(?:p|li|div)[^>]*>([^<]+)</(?:p|li|div)>', 1)"

_LONG = f"WITH b AS (SELECT page_id, {_BLOCKS} AS bs FROM pages), e AS (SELECT page_id, unnest(range(len(bs))) AS pos, {_squeezed('unnest(bs)')} AS t FROM b), f AS (SELECT page_id, arg_min(t, pos) AS t FROM e WHERE length(t) > 100 AND length(t) < 5000 AND NOT regexp_matches(t, '^[₹0-9]') GROUP BY page_id, substr(t, 1, 50)) SELECT page_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM f WHERE NOT regexp_matches(lower(t), '{'|'.join(P.BOILERPLATE).replace(chr(39), chr(39) * 2)}') GROUP BY 1"

Q = {
    "n5_extract_products": (
        lambda s, d: E.extract_products(_shaped(s, d)).select("url", "status", "title", "description", "price", "weight", "dimensions", "gst", "hsn", F.size("images").cast("long").alias("n_images")),
        f"{_SHAPED} SELECT url, status, CASE WHEN status = 'success' THEN name END AS title, coalesce(description, CASE WHEN k = 5 THEN 'meta' END) AS description, found AS price, weight, dimensions, gst, hsn, CASE WHEN k = 1 THEN 1 ELSE 0 END::BIGINT AS n_images FROM x",
    ),
    "n5_extract_pages": (
        lambda s, d: E.extract_products(scan(s, d, "pages")).groupBy("status").agg(F.count("*").alias("n"), F.count("title").alias("n_title"), F.count("price").alias("n_price")),
        "WITH h AS (SELECT CASE WHEN contains(html, '__NEXT_DATA__') OR contains(html, 'ld+json') THEN error('a page of another shape') ELSE NULLIF(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), '') END AS title, regexp_matches(html, '₹\\s*[\\d,]') AS priced FROM pages) SELECT CASE WHEN title IS NULL THEN 'blocked' ELSE 'success' END AS status, count(*) AS n, count(title) AS n_title, count(*) FILTER (priced) AS n_price FROM h GROUP BY 1",
    ),
    "n4_state_products": (
        lambda s, d: E.state_products(_shaped(s, d)).select("url", "product_id", "title", "description", "price", F.size(F.coalesce("images", F.array().cast("array<string>"))).cast("long").alias("n_images"), F.map_keys("specs").alias("k")).withColumn("k", F.array_join(F.array_sort("k"), ",")),
        f"{_SHAPED} SELECT url, CASE WHEN k = 1 THEN t END AS product_id, name AS title, description, found AS price, CASE WHEN k = 1 THEN 1 ELSE 0 END::BIGINT AS n_images, CASE WHEN k = 1 THEN 'Net Weight,Size' END AS k FROM x WHERE k IN (0, 1)",
    ),
    "n4_stream_details": (
        lambda s, d: E.stream_details(_pushed(s, d)),
        "SELECT url, CAST(num AS VARCHAR) AS price, '9' AS mrp_price, coalesce(category, 'none') AS category, 'a & b' AS brand FROM products_v WHERE num % 5 <> 0",
    ),
    "n2_grid_pairs": (
        lambda s, d: _shaped(s, d).select("url", F.explode(E.grid_specs(F.col("html"))).alias("label", "value")),
        f"{_SHAPED} SELECT url, 'Weight' AS label, concat(t, ' kg') AS value FROM x WHERE k IN (0, 3) UNION ALL SELECT url, 'GST rate', '5%' FROM x WHERE k = 2 UNION ALL SELECT url, 'HSN', t FROM x WHERE k = 2",
    ),
    "n6_page_images": (
        lambda s, d: _images(s, d).select("id", F.array_join(E.image_list(F.col("html")), " ").alias("images")),
        "SELECT id, concat_ws(' ', concat('https://m.shop.example/I/a', num, '._SL1500_.jpg'), CASE WHEN num % 3 <> 0 THEN concat('https://m.shop.example/I/b', num, '._SL1500_.png') END, CASE WHEN num % 2 = 0 THEN 'https://m.shop.example/I/c._Xraw.webp' END) AS images FROM products_v",
    ),
    "n11_wide_records": (
        lambda s, d: E.wide_records(E.extract_products(_shaped(s, d)), T.product_code(F.col("url")), "the shop").select("id", "title", "image_url", "price", "status", "error"),
        f"{_SHAPED} SELECT t AS id, CASE WHEN status = 'success' THEN name ELSE 'Blocked by the shop' END AS title, CASE WHEN k = 1 THEN 'https://cdn.shop.example/a_512.jpg' END AS image_url, found AS price, status, CASE WHEN status = 'blocked' THEN 'Request blocked by the shop' END AS error FROM x",
    ),
    "t6_hires_image": (
        lambda s, d: view(s, d, "products_v").select("id", T.hires_image(F.concat(F.lit("https://m.shop.example/I/"), "id", F.when(F.col("num") % 3 == 0, "._AC_UL320_.jpg").when(F.col("num") % 3 == 1, ".webp").otherwise("._Xraw.png"))).alias("u")),
        "SELECT id, concat('https://m.shop.example/I/', id, CASE num % 3 WHEN 0 THEN '._SL1500_.jpg' WHEN 1 THEN '._SL1500_.webp' ELSE '._Xraw.png' END) AS u FROM products_v",
    ),
    "t8_product_code": (
        lambda s, d: view(s, d, "mappings_v").select("product_id", T.product_code(F.coalesce("amazon_url", "flipkart_url", F.concat(F.lit("https://x.example/gp/product/ABCDEFGH"), F.lpad(F.col("num").cast("string"), 2, "0"), F.lit("/ref")))).alias("code")),
        "SELECT product_id, CASE WHEN num % 3 = 0 THEN lpad(CAST(num AS VARCHAR), 10, 'B') WHEN num % 4 = 0 THEN CAST(num AS VARCHAR) ELSE concat('ABCDEFGH', lpad(CAST(num AS VARCHAR), 2, '0')) END AS code FROM mappings_v",
    ),
    "t11_dimensions_in_text": (
        lambda s, d: scan(s, d, "part").select("p_partkey", T.extract_dimensions(F.concat(F.when(F.col("p_partkey") % 2 == 0, "Size: ").otherwise("about "), "p_size", F.lit(",5 x 4"), F.when(F.col("p_partkey") % 3 != 0, "").when(F.col("p_partkey") % 5 == 0, " * 7abc").otherwise(" × 7 cm"))).alias("dims")),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND (p_partkey % 5 <> 0 OR p_partkey % 2 = 0) THEN concat(p_size, '.5 x 4 x 7') WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN concat(p_size, '.5 x 4') END AS dims FROM part",
    ),
    "f8_robot_pages": (
        lambda s, d: scan(s, d, "pages").select("page_id", T.is_robot_page(F.col("html"), F.col("url")).alias("robot"), T.is_robot_page(F.col("html"), F.col("url"), 0).alias("asked"), T.is_refused_page(F.col("html")).alias("refused")),
        f"WITH p AS (SELECT page_id, html, lower(html) AS low, contains(lower(url), 'validatecaptcha') OR {_contains_any('lower(html)', T.ROBOT_MARKS)} AS asked FROM pages) SELECT page_id, asked OR (length(low) < 10000 AND NOT contains(low, 'producttitle')) AS robot, asked, contains(low, 'captcha') OR {_contains_any('html', T.REFUSAL_MARKS)} AS refused FROM p",
    ),
    "f13_check_requests": (
        lambda s, d: C.check_requests(_requests(s, d), ["flipkart", "amazon", "meesho"]).select("l_orderkey", F.array_join("violations", ",").alias("violations")),
        "SELECT l_orderkey, concat_ws(',', CASE WHEN count(*) > 5 THEN 'products' END, CASE WHEN count(*) FILTER (l_partkey % 97 = 0) > 0 THEN 'fields' END, CASE WHEN l_orderkey % 4 = 3 THEN 'platform' END) AS violations FROM lineitem GROUP BY 1",
    ),
    "f16_long_texts": (lambda s, d: P.long_texts(scan(s, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n")), f"SELECT page_id, n FROM ({_LONG})"),
    "f16_long_text_starts": (lambda s, d: P.long_texts(scan(s, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), _LONG),
    "f17_search_titles": (
        lambda s, d: P.search_records(view(s, d, "products_v").select("id", F.when(F.col("num") % 3 != 0, F.upper("name")).alias("title"), "url"), "Small ring").select("id"),
        "SELECT id FROM products_v WHERE contains(lower(url), 'small ring') OR (num % 3 <> 0 AND contains(lower(name), 'small ring'))",
    ),
    "j6_merge_fields": (
        lambda s, d: C.merge_detail(view(s, d, "products_v").select("id", "category", "brand"), view(s, d, "gateway_v").select("id", "category", "brand"), ["category", "brand"], "id"),
        "SELECT p.id, coalesce(NULLIF(g.category, ''), p.category) AS category, coalesce(NULLIF(g.brand, ''), p.brand) AS brand, CASE WHEN coalesce(NULLIF(g.category, ''), g.brand) IS NOT NULL THEN 'success' WHEN coalesce(p.category, p.brand) IS NOT NULL THEN 'extracted' ELSE 'failed' END AS status FROM products_v p LEFT JOIN gateway_v g ON p.id = g.id",
    ),
    "a13_run_outcomes": (
        lambda s, d: P.outcome_counts(E.extract_products(_shaped(s, d))),
        f"{_SHAPED} SELECT count(*) AS n, count(*) FILTER (status = 'success') AS n_success, 0::BIGINT AS n_failed, count(*) FILTER (status = 'blocked') AS n_blocked FROM x",
    ),
    "a15_products_count": (lambda s, d: C.catalog_count(view(s, d, "products_v")), "SELECT count(*) AS n FROM products_v"),
    "a18_checkout_status": (
        lambda s, d: M.checkout_status(_checkouts(s, d)).select("seq", "status", "reason"),
        "WITH c AS (SELECT p_partkey AS n, p_partkey % 11 <> 0 AND p_partkey % 3 = 0 AS waiting, p_partkey % 11 <> 0 AND p_partkey % 2 = 0 AS paid, p_partkey % 7 <> 0 AND p_partkey % 5 = 0 AS gateway FROM part) SELECT n AS seq, CASE WHEN gateway AND paid THEN 'pass' WHEN waiting OR paid THEN 'degraded' ELSE 'fail' END AS status, CASE WHEN gateway AND paid THEN NULL WHEN waiting THEN 'bargain in progress' WHEN paid THEN 'gateway not detected' ELSE 'no pay button' END AS reason FROM c",
    ),
    "m13_reel_relevance": (
        lambda s, d: V.scored(view(s, d, "videos_v").repartition("product_key", "seq"), F.col("seq") % 4 == 0).select("product_key", "seq", "relevance"),
        f"WITH {_REL.format(src='videos_v')} SELECT product_key, seq, relevance + CASE WHEN seq % 4 = 0 THEN 15.0 ELSE 0.0 END AS relevance FROM rel",
    ),
    "t19_chat_report": (
        lambda s, d: M.chat_report(M.flow_scores(view(s, d, "check_results_v"))),
        f"{_OVERALL.format(icon=_ICON)}, l AS (SELECT string_agg(concat(icon, ' ', flow, ': ', score, '/100 (P', n_pass, '/D', n_degraded, '/F', n_fail, ')'), chr(10) ORDER BY score, flow) AS shown, string_agg(concat('   • ', flow, ' — ', n_fail, ' failing'), chr(10) ORDER BY score, flow) FILTER (score < 60) AS broken FROM f) SELECT concat('📊 *Daily Health Summary — ', overall, '/100*', chr(10), '_Window: last 24h · ', total, ' checks_', chr(10), chr(10), shown, chr(10) || chr(10) || '⚠️ *Not in order:*' || chr(10) || broken) AS message FROM l, o",
    ),
    "t19_mail_report": (
        lambda s, d: M.mail_report(M.flow_scores(view(s, d, "check_results_v")), "Daily Health Summary", "2026-01-01 00:00"),
        f"{_OVERALL.format(icon=_ICON)}, l AS (SELECT string_agg(concat(icon, ' ', flow, ': ', score, '/100 (pass ', n_pass, ' / degraded ', n_degraded, ' / fail ', n_fail, ')'), chr(10) ORDER BY score, flow) AS shown, string_agg(concat('🔴 ', flow, ' — ', n_fail, ' failing of ', total, ' checks'), chr(10) ORDER BY score, flow) FILTER (score < 60) AS broken FROM f) SELECT concat_ws(chr(10), 'Daily Health Summary', repeat('=', 50), 'Generated: 2026-01-01 00:00', 'Window: last 24h', concat('Total checks: ', total), concat('Overall health score: ', overall, '/100'), '', 'PER-FLOW SCORES', repeat('-', 50), shown, '', 'NOT IN ORDER (failing even when average is OK)', repeat('-', 50), coalesce(broken, 'No flows are consistently failing today.')) AS body FROM l, o",
    ),
    "t19_cause_text": (_causes, f"SELECT seq, {_TEXT} AS message, replace(replace({_TEXT}, '*', ''), '`', '') AS plain FROM check_results_v"),
    "u4_merged_warnings": (
        lambda s, d: V.merged_warnings(view(s, d, "videos_v").select("product_key", F.when(F.col("seq") % 3 != 0, F.array(F.substring("title", 1, 3), F.coalesce("duration", F.lit("-")))).alias("warnings")), ["product_key"]).select("product_key", F.array_join("warnings", ",").alias("w")),
        "WITH x AS (SELECT product_key, unnest(CASE WHEN seq % 3 <> 0 THEN [substr(title, 1, 3), coalesce(duration, '-')] ELSE [NULL] END) AS w FROM videos_v) SELECT product_key, coalesce(string_agg(DISTINCT w, ',' ORDER BY w), '') AS w FROM x GROUP BY 1",
    ),
}


def queries() -> dict:
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: with_views(sql) for k, (_, sql) in Q.items() if sql}
