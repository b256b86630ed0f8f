"""Work that stays in its row: once a page, and without rows of each part."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from opsframe.operators import extraction as E
from opsframe.operators import pages as P
from opsframe.operators import videos as V


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_state_is_read_once_a_page(spark):
    page = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"product":{"name":"%s","price":%s}}}}</script>'
    df = spark.createDataFrame([("u", page % ("a  b", 5)), ("v", page % ("", 5)), ("w", None), ("x", page % ("c", 0))], "url string, html string")
    found = E.state_products(df)
    assert sorted((r.url, r.title, r.price) for r in found.collect()) == [("u", "a b", "5"), ("x", "c", None)]
    assert _plan(found).split("Generate explode", 2)[-1].count("regexp_extract(html") == 1 and "Filter" not in re.sub(r"filter\(", "", _plan(found))


def test_queries_of_a_product_stay_in_its_row(spark):
    kind = "product_key long, name string, categories array<struct<category:string,confidence:double>>, features array<string>"
    rows = [(1, "a red red lamp", [("desk lamp", 0.5), ("desk lamp", 0.25)], ["shiny"]), (2, None, [], []), (3, "big chair", None, None), (1, "other", [("desk lamp", 0.5)], [])]
    found = V.generated_queries(spark.createDataFrame(rows, kind), 20)
    assert "Window" not in _plan(found) and _plan(found).count("Exchange") == 1
    got = [r for r in found.collect() if r.product_key == 1]
    assert len({r.q for r in got}) == len(got) and {r.product_key for r in found.collect()} == {1}
    assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))
    assert [r.weight for r in sorted(got, key=lambda r: r["rank"])] == sorted((r.weight for r in got), reverse=True)


def test_pairs_of_a_page_stay_in_its_row(spark):
    html = "<dl><dt>b</dt><dd>1</dd><dt>a</dt><dd>2</dd><dt>b</dt><dd>3</dd></dl><li><b>c:</b> 4</li><th>d</th><td>₹5</td>"
    found = P.spec_pairs(spark.createDataFrame([("u", html), ("v", "<p>"), ("w", None), ("u", "<dt>z</dt><dd>9</dd><dt>a</dt><dd>8</dd>")], "url string, html string"))
    assert _plan(found).count("Exchange") == 1
    got = {r.url: r.specs for r in found.collect()}
    assert set(got) == {"u"} and set(got["u"]) == {"a", "b", "c", "z"} and got["u"]["b"] == "1" and got["u"]["c"] == "4"


def test_texts_are_normalised_once_a_row(spark):
    from pyspark.sql import functions as F

    from opsframe.functions import scores as S

    df = spark.createDataFrame([("big red chair", "red chair", 10)], "title string, name string, views long")
    shown = _plan(df.select(S.relevance(F.col("title"), F.col("name"), F.col("views"))))
    assert [len(re.findall(rf"lower\({c}#", shown)) for c in ("title", "name")] == [1, 1], shown
    shown = _plan(df.select(S.image_url_equal(F.col("title"), F.col("name"))))
    assert [len(re.findall(rf"substring_index\({c}#", shown)) for c in ("title", "name")] == [1, 1], shown


def test_a_worker_holds_one_cell_of_pairs(spark):
    from opsframe.operators import duplicates as D

    rows = [(i, [float(i % 7 == k) + 0.01 * i for k in range(7)]) for i in range(60)] + [(99, [1.0]), (98, [2.0]), (97, None)]
    found = D.similar_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.99, rows=10)
    assert "CoGroups" in _plan(found) and "Join" not in _plan(found)
    unit = lambda v: sum(x * x for x in v) ** 0.5
    want = {(i, j) for i, v in rows for j, w in rows if v and w and i < j and len(v) == len(w) and sum(x * y for x, y in zip(v, w)) / unit(v) / unit(w) >= 0.99}
    assert {(r.src, r.dst) for r in found.collect()} == want and found.count() == len(want)


def test_a_state_is_opened_in_its_row(spark):
    product = '{"id":%d,"name":"n%d","v":[{"productId":"w%d","title":"","x":{"product_id":1.50,"productName":"deep","price":null}}]}'
    state = '{"a":{"b":[[' + ",".join(product % (i, i, i) for i in range(3000)) + '],[],{},null,"s",[7]]},"id":"top","name":"t","price":"9"}'
    pages = spark.range(2).select(F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") == 0, F.lit(f'<script id="__STATE__">{state}</script>')).otherwise("").alias("html"))
    got = P.deep_state_products(pages)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # no level is stored or shuffled, and no state is walked once a level
    assert plan.count("Generate explode") == 1 and "Union" not in plan and "LogicalRDD" not in plan
    want = [("u0", "top", "t", "9")] + [("u0", str(i), f"n{i}", None) for i in range(3000)] + [("u0", "1.5", "deep", None)] * 3000
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
