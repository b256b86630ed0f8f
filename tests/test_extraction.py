"""Records out of pages that are null, empty, broken or repeated."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions import text as T
from opsframe.operators import catalog as C
from opsframe.operators import extraction as E
from opsframe.operators import monitoring as M
from opsframe.operators import videos as V

PAGES = "url string, html string, title string"


def test_defined_cases(spark):
    state = '<script id="__NEXT_DATA__">%s</script>'
    rows = [
        ("null", None, "x"),
        ("empty", "", "x"),
        ("twice", "<h1>a</h1>", None),
        ("twice", "<h1>a</h1>", None),
        ("list", state % "[1, 2]" + "<h1>b</h1>", None),
        ("empty data", state % '{"props":{"pageProps":{"product":{},"data":{"name":"c","images":[]}}}}', None),
        ("no name", state % '{"props":{"pageProps":{"product":{"price":3}}}}' + "<h1> </h1>", None),
        ("graph", '<script type="application/ld+json">{"@graph":[{"@type":"WebPage","name":"w"},{"@type":"Product","name":"d"}]}</script>', None),
        ("long", "<h1>" + "e" * 2_000_000 + "</h1>", None),
    ]
    got = [(r.url, r.status, r.title if r.url != "long" else len(r.title), r.images) for r in E.extract_products(spark.createDataFrame(rows, PAGES)).collect()]
    want = [("null", "blocked", None), ("empty", "blocked", None), ("twice", "success", "a"), ("twice", "success", "a"), ("list", "success", "b"), ("empty data", "success", "c"), ("no name", "blocked", None), ("graph", "success", "d"), ("long", "success", 500)]
    assert sorted(got, key=str) == sorted(((*w, []) for w in want), key=str)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], PAGES)
    assert E.extract_products(pages).count() == E.state_products(pages).count() == E.stream_details(pages).count() == 0
    requests = spark.createDataFrame([], "products array<struct<id:string,name:string>>, platforms array<string>")
    assert C.check_requests(requests, ["a"]).count() == 0


def test_requests(spark):
    rows = [(None, None), ([], ["a"]), ([("1", "x")], [None]), ([("1", None)], []), ([("1", "x")] * 5, ["a", "b"]), ([("1", "x")] * 6, ["a"])]
    requests = spark.createDataFrame(rows, "products array<struct<id:string,name:string>>, platforms array<string>")
    got = [r.violations for r in C.check_requests(requests, ["a"]).collect()]
    assert got == [["products"], ["products"], ["platform"], ["fields"], ["platform"], ["products"]]


def test_merge_detail_with_missing_values(spark):
    listing = spark.createDataFrame([("a", "1", None), ("a", "1", None), ("b", "", None), ("c", None, "2"), (None, "4", None)], "url string, price string, brand string")
    detail = spark.createDataFrame([("a", "", "x"), ("b", "", None), (None, "9", "9")], "url string, price string, brand string")
    got = sorted((tuple(r) for r in C.merge_detail(listing, detail, ["price", "brand"]).select("url", "price", "brand", "status").collect()), key=str)
    assert got == sorted([("a", "1", "x", "success")] * 2 + [("b", None, None, "failed"), ("c", None, "2", "extracted"), (None, "4", None, "extracted")], key=str)


def test_links_and_sizes(spark):
    one = lambda f, values: [r.v for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x")).alias("v")).collect()]
    assert one(T.product_code, ["https://a/dp/B000000001?x", "https://f/p?pid=ab&x=1", "https://m/p/77?q", "https://m/", "", None]) == ["B000000001", "ab", "77", "https://m/", "", None]
    assert one(T.hires_image, ["a._SL1500_.jpg", "a._AC_SX1_.PNG", "a.jpeg", "a.svg", None]) == ["a._SL1500_.jpg", "a._SL1500_.PNG", "a._SL1500_.jpeg", "a.svg", None]
    assert one(T.extract_dimensions, ["10x4,5×3cm", "a10x4x3", "dim: 10x4x3z", "dims 2 x 3", "2 x 3", None]) == ["10 x 4.5 x 3", None, "10 x 4 x 3", "2 x 3", None, None]


def test_warnings_and_causes(spark):
    w = spark.createDataFrame([(1, ["b", "a"]), (1, ["a", None]), (1, None), (2, None), (3, [])], "k int, warnings array<string>")
    assert {r.k: r.warnings for r in V.merged_warnings(w, ["k"]).collect()} == {1: ["a", "b"], 2: [], 3: []}
    none = F.lit(None).cast("array<string>")
    text = spark.range(1).select(M.cause_text(F.lit("n"), F.lit("s"), F.lit("high"), none, none, none).alias("m")).first().m
    assert text.count("\n") == 6 and "HIGH" in text
