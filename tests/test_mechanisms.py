"""Order statistics, stored tables, bands of signs, fallback hashes, streams in parts and rules as constants."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.functions import scores as S
from opsframe.functions import text as T
from opsframe.operators import duplicates as D
from opsframe.operators import keyed as K
from opsframe.operators import lsh
from opsframe.operators import matching as M
from opsframe.operators import monitoring as O
from opsframe.operators import pages as P
from opsframe.operators import videos as V
from opsframe.operators.graph import components
from opsframe.plans import monitoring_queries, registry
from opsframe.sources import readers, sinks
from opsframe.sources.stored import StoredTable
from opsframe.streaming import checks as X

SF = "/root/testdata/sf0.01"


def positions(rows):
    return [(r.position, r.a, r.b) for r in sorted(rows, key=lambda r: r.position)]


@pytest.mark.parametrize("kind", ["spread", "hot", "equal", "nulls"])
def test_ranges_of_an_order(spark, kind):
    rng = random.Random(3)
    pick = {"spread": lambda: rng.randrange(10**6), "hot": lambda: 5 if rng.random() < 0.7 else rng.randrange(10), "equal": lambda: 1, "nulls": lambda: rng.choice([None, None, 2, 3])}[kind]
    rows = [(pick(), f"k{rng.randrange(40)}" if rng.random() < 0.8 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, draw int").repartition(5)
    first = lambda v: (v is not None, v if v is not None else 0)
    order = sorted(((a, b) for a, b, _ in rows), key=lambda r: (first(r[0]), (r[1] is not None, r[1] or "")))
    for lo, hi in ((1, 5), (1200, 1230), (2990, 3005), (4000, 4010)):
        want = [(i + 1, *order[i]) for i in range(lo - 1, min(hi, 3000))]
        assert positions(K.range_select(df, ["a", "b"], lo, hi, few=50).collect()) == want
    assert positions(K.range_select(df, ["a", "b"], 2501, 0).collect()) == [(i + 1, *order[i]) for i in range(2500, 3000)]
    ids = [r.draw for r in K.range_select(df, ["a", "b", "draw"], 700, 760, few=50).collect()]
    assert len(set(ids)) == 61 and K.range_select(df.limit(0), ["a"], 1, 5).collect() == []
    page = K.paginate(df, 10**6, 40, ["a", "b", "draw"]).collect()
    assert len(page) == 40 and {(r.total, r.total_pages) for r in page} == {(3000, 75)}


def test_order_statistic_writes_nothing(spark):
    df = spark.range(5000).withColumn("id", F.col("id") * 7 % 5003)
    start = K.order_statistic(df, ["id"], 2500, few=100)
    assert start.before <= 2499 < start.before + 100
    plan = K.range_select(df, ["id"], 2500, 2520, few=100)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan


def test_upsert_with_names_of_its_own(spark):
    target = spark.createDataFrame([(1, "a", "x", None), (2, "b", "y", "z")], "k int, new string, __new string, `bucket` string")
    updates = spark.createDataFrame([(2, None, "w"), (3, "c", "v")], "k int, new string, __new string")
    got = {tuple(r) for r in K.merge_upsert(target, updates, ["k"], ["new", "__new"]).collect()}
    assert got == {(1, "a", "x", None), (2, None, "w", "z"), (3, "c", "v", None)}
    assert {tuple(r) for r in K.patch(target, updates, "k", ["new"]).collect()} == {(1, "a", "x", None), (2, "b", "y", "z")}


def files_of(table):
    return {b: p for b, p in table.manifest()["files"].items()}


def test_stored_table_changes_what_is_touched(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit("old").alias("bucket"))
    table = StoredTable.create(spark, f"{tmp_path}/t", rows, ["id"], 32)
    assert table.read().count() == 1000
    before = files_of(table)
    touched = table.upsert(spark.createDataFrame([(5, "five"), (5000, None)], "id long, name string"), ["name"])
    after = files_of(table)
    assert 1 <= len(touched) <= 2 and {b for b in before if before[b] != after[b]} == {str(b) for b in touched}
    got = {r.id: (r.name, r.bucket) for r in table.read().where("id in (5, 6, 5000)").collect()}
    assert got == {5: ("five", "old"), 6: ("n6", "old"), 5000: (None, None)}
    table.patch(spark.createDataFrame([(5, ""), (6, "six"), (9999, "no")], "id long, name string"), ["name"])
    table.delete(spark.createDataFrame([(7,), (7,), (8888,)], "id long"))
    assert table.read().count() == 1000 and {r.name for r in table.read().where("id in (5, 6, 7)").collect()} == {"five", "six"}
    assert table.upsert(table.read().limit(0), ["name"]) == [] and table.read().count() == 1000


def test_failed_write_leaves_the_table(spark, tmp_path):
    table = StoredTable.create(spark, f"{tmp_path}/t", spark.range(100).withColumn("v", F.lit(1)), ["id"], 8)
    before, stale = table.manifest(), StoredTable(spark, f"{tmp_path}/t")
    with pytest.raises(Exception, match="broken"):
        table.upsert(spark.range(50).withColumn("v", F.when(F.col("id") == 40, F.raise_error(F.lit("broken"))).otherwise(2).cast("int")), ["v"])
    assert table.manifest() == before and table.read().agg(F.sum("v")).head()[0] == 100
    table.upsert(spark.range(10).withColumn("v", F.lit(3)), ["v"])
    with pytest.raises(RuntimeError, match="written by another"):
        stale._publish(before, before["files"])
    assert stale.read().agg(F.sum("v")).head()[0] == 120


def test_batches_are_merged_once(spark, tmp_path):
    table = StoredTable.create(spark, f"{tmp_path}/t", spark.createDataFrame([], "k int, v int"), ["k"], 4)
    merge = table.upsert_batch("s", ["v"])
    one, two = (spark.createDataFrame([(1, v), (v, v)], "k int, v int") for v in (10, 20))
    merge(one, 0), merge(two, 1)
    state = table.manifest()
    merge(one, 0), merge(two, 1)
    assert table.manifest() == state and {tuple(r) for r in table.read().collect()} == {(1, 20), (10, 10), (20, 20)}


def vectors_of(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>")


def test_bands_find_what_they_plan(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 32))
    near = base[:200] + rng.standard_normal((200, 32)) * 0.45
    data = [(i, v.tolist()) for i, v in enumerate(np.vstack((base, near)))]
    data += [(i + 1000, [0.0] * 32) for i in range(3)] + [(2000, None), (2001, [float("nan")] * 32), (2002, [1.0, None]), (2003, [1.0]), (None, base[0].tolist())]
    data += [(3000 + i, base[7].tolist()) for i in range(60)] + [(7, base[7].tolist())]
    df = vectors_of(spark, data)
    exact = {(r.src, r.dst) for r in D.similar_pairs(df, 0.8).collect()}
    rows = lsh.similar_pairs(spark, df, 0.8, recall=0.95, block=64).collect()
    found = {(r.src, r.dst) for r in rows}
    assert found <= exact and len(found) >= 0.95 * len(exact) > 1500 and min(r.similarity for r in rows) >= 0.8
    # copies make no pairs of their own before they are expanded
    links = lsh.similarity_links(spark, df, 0.8, recall=0.999, block=64)
    parts = lambda pairs: {frozenset(g) for g in groups(pairs)}
    assert links.count() < 700 and parts([(r.src, r.dst) for r in links.collect()]) == parts(exact)
    assert lsh.similar_pairs(spark, df.limit(0), 0.8).collect() == []
    p = lsh.plan(10**9, 0.8, 0.95)
    assert p.recall >= 0.95 and p.bits > lsh.plan(1000, 0.8, 0.95).bits


def test_no_pair_is_missed_without_a_recall(spark):
    """Pairs just above the least cosine, of which bands with a recall of 0.99 miss some; blocks of a few rows."""
    rng = np.random.default_rng(6)
    one, other = rng.standard_normal((2, 1500, 32))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.8005 * one + np.sqrt(1 - 0.8005**2) * other
    data = [(i, (v * (1 + i % 3)).tolist()) for i, v in enumerate(np.vstack((one, near)))] + [(5000, None), (5001, [1.0]), (5002, [2.0]), (5003, one[3].tolist())]
    df = vectors_of(spark, data)
    exact = {(r.src, r.dst) for r in D.similar_pairs(df, 0.8).collect()}
    assert {(i, i + 1500) for i in range(1500)} <= exact
    assert {(r.src, r.dst) for r in lsh.similar_pairs(spark, df, 0.8).collect()} == exact
    parts = lambda pairs: {frozenset(g) for g in groups(pairs)}
    assert parts([(r.src, r.dst) for r in lsh.similarity_links(spark, df, 0.8).collect()]) == parts(exact)


def test_blocks_leave_no_component_apart(spark):
    """Many small blocks: a row near to all rows of another component keeps one pair with it, not all."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal(8)
    rows = spark.createDataFrame([(i, i % 2, (base + rng.standard_normal(8) * 0.01).tolist(), 8) for i in range(400)], "row long, component long, v array<double>, dims int")
    some = lsh.met_in_blocks(spark, rows, 0.8, apart=True, packed=2000).collect()
    assert 0 < len(some) < 10_000 and all(r.a % 2 != r.b % 2 for r in some)
    assert lsh.met_in_blocks(spark, rows, 0.8, packed=2000).count() == 400 * 399 // 2
    assert lsh.met_in_blocks(spark, rows.limit(0), 0.8).count() == 0


def groups(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    out = {}
    for x in list(up):
        out.setdefault(root(x), set()).add(x)
    return out.values()


def test_large_buckets_are_met_in_blocks(spark):
    """A bucket of all rows: no cell of two blocks has more than a fixed number of rows."""
    p = lsh.Plan(bits=1, bands=1, recall=1.0, most_differing=256)
    signed = spark.range(900).select("id", F.array(F.lit(0).cast("long")).alias("bands"), F.array(*[F.col("id")] * 4).alias("sketch"))
    rows = lsh.bucket_rows(signed)
    assert lsh.candidates(rows, p, block=100).count() == 900 * 899 // 2
    assert lsh.candidates(rows.withColumn("c", F.col("id") % 3), p, 100, "c").count() == 3 * 300 * 300
    assert lsh.led_pairs(rows, p).count() == 899


def test_wide_hashes_against_brute_force(spark):
    rng = random.Random(9)
    near = lambda h: h ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(9)))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    seeds = [rng.getrandbits(64) for _ in range(12)]
    rest = [(f"r{i}", signed(near(rng.choice(seeds)))) for i in range(80)] + [("null", None), ("r1", signed(seeds[0])), ("far", 12345)]
    mapped = [(f"m{i:03}", signed(near(rng.choice(seeds)))) for i in range(120)] + [(f"hot{i:03}", signed(seeds[1])) for i in range(200)] + [("mnull", None), (None, signed(seeds[2]))]
    left, right = spark.createDataFrame(rest, "id string, phash long"), spark.createDataFrame(mapped, "id string, phash long")
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    want = set()
    for i, h in rest:
        hits = sorted((apart(h, g), m) for m, g in mapped if h is not None and g is not None and m is not None and apart(h, g) < 10)
        want |= {(i, h, m, d, k + 1) for k, (d, m) in enumerate(hits[:3])}
    join = left.withColumnRenamed("phash", "own")
    got = D.fallback_candidates(spark, left, right)
    assert {(r.id, r.mapped_id, r.distance, r["rank"]) for r in got.collect()} == {(i, m, d, k) for i, _, m, d, k in want}
    assert join.count() == len(rest)
    brand = lambda df: df.withColumn("brand", F.lit(" x "))
    pairs = [(r.id, r.mapped_id, r.distance) for r in D.block_candidates(brand(left), brand(right)).collect()]
    assert sorted(pairs, key=str) == sorted([(i, m, apart(h, g)) for i, h in rest for m, g in mapped if h is not None and g is not None and apart(h, g) < 10], key=str)


def test_plain_scorer_adds_up(spark):
    rows = [("red chair", "Red  chair x", True), ("a b", "c d", True), ("", " ", False), (None, "a", False), ("a a b", "a c", False)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    got = [r[0] for r in df.select(S.overlap_score(F.col("same"), F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(100 + 100 / 3), 100.0, 0.0, 0.0, 25.0]
    offers = [(1, "red chair", "u/i.jpg", "no", "x.jpg", 1), (1, "red chair", "u/i.jpg", "red", "u/i.jpg", 2), (1, "red chair", "u/i.jpg", "red", "u/i.jpg", 3), (2, "lamp", None, "no", None, 5), (2, "lamp", None, "never", None, 4)]
    best = M.best_overlap(spark.createDataFrame(offers, "product_key int, title string, image_url string, cand_title string, cand_image string, seq int"), "seq").collect()
    assert sorted((r.product_key, r.offer.seq, r.match_score, r.image_match) for r in best) == [(1, 2, 125.0, True), (2, 4, 0.0, False)]


def test_specifications_keep_page_order(spark):
    specs = "map('Size', 'big; red', 'Net Weight', '1 kg', 'A weight', '2 kg', 'Dimensions', '3; 4')"
    r = spark.range(1).select(F.expr(specs).alias("s")).select(T.spec_derive(F.col("s")).alias("a"), T.spec_derive(F.col("s"), False).alias("b")).head()
    assert tuple(r.a) == ("1 kg", "big", None, None) and tuple(r.b) == ("2 kg", "3; 4", None, None)
    none = spark.range(1).select(F.expr("cast(null as map<string,string>)").alias("s")).select(T.spec_derive(F.col("s")).alias("a")).head()
    assert tuple(none.a) == (None,) * 4


def test_rules_are_a_constant(spark):
    rules = [dict(group_key="home", group_order=1, template_key="slow", template_order=0, summary="b"), dict(group_key="ho", group_order=0, template_key="x", template_order=0, summary="a", actions=["1", "2", "3", "4"])]
    rows = [(1, "home", "m", "fail", "Slow page"), (2, "home", "m", "fail", None), (3, "other", "m", "fail", "slow"), (4, None, "m", "fail", "x"), (5, "who", "m", "pass", "x")]
    df = spark.createDataFrame(rows, "seq int, page string, metric string, status string, step_failed string")
    assert [r.summary for r in O.root_cause(df, rules).orderBy("seq").collect()] == ["b", "a", "generic", "generic", "a"]
    assert [(r.seq, r.causes) for r in O.merged_causes(df, rules).orderBy("seq").collect()] == [(1, ["a", "b"]), (2, ["a", "b"]), (5, ["a"])]
    texts = [r.text for r in O.alert_failures(df, rules).orderBy("seq").collect()]
    assert texts[1] == "home/m: missing\n  RCA: a\n  Actions: 1; 2; 3" and texts[2].endswith("RCA: generic\n  Actions: ")
    with pytest.raises(ValueError, match="1001 rules"):
        O.root_cause(df, rules[:1] * 1001)
    for plan in (O.root_cause(df, rules), O.merged_causes(df, rules), O.root_cause(df, [])):
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in shown and "Exchange" not in shown


def test_labels_are_a_constant(spark):
    labels = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [-3.0, 0.0])]
    df = vectors_of(spark, [(1, [5.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])])
    got = [(r.vec_id, r.label, r["rank"]) for r in V.top_labels(df, labels, 2).orderBy("vec_id", "rank").collect()]
    assert got == [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2)]
    assert [(r.vec_id, r.label) for r in V.top_labels(df, labels, 5, 0.1).orderBy("vec_id", "rank").collect()] == [(1, "a"), (2, "a"), (2, "b")]
    shown = V.top_labels(df, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in shown and "Window" not in shown and "Exchange" not in shown
    assert V.top_labels(df, []).collect() == []


def test_no_nested_loops(spark):
    """No lazily built plan of a registered query of rules, labels or runs joins by a nested loop."""
    for name in ("j13_root_cause", "n8_merged_causes", "w8_top_labels", "a8_latest_run_summary", "a16_alert_failures", "a16_alert_digest", "m16_threshold_violations", "m17_budget_status", "j15_attach_recording", "j7_block_candidates", "j8_global_candidates", "a7_failing_details"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_days_are_pruned(spark, tmp_path):
    rows = [(i, datetime(2024, 3, 1) + timedelta(hours=i)) for i in range(240)]
    df = spark.createDataFrame(rows, "seq long, run_at timestamp").withColumn("details", F.lit("d"))
    sinks.append_checks(df, f"{tmp_path}/c")
    # files of other days are not read: they may be broken
    for file in (tmp_path / "c").glob("run_date=2024-03-0[2-7]/*.parquet"):
        file.write_bytes(b"broken")
    recent = sinks.scan_checks(spark, f"{tmp_path}/c", "2024-03-09 12:00:00", 24)
    assert recent.count() == 240 - 180
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan


def test_append_is_tried_without_details(spark, tmp_path):
    rows = spark.range(4).select(F.lit("2024-03-01").cast("timestamp").alias("run_at"), "id", F.raise_error(F.lit("broken")).cast("string").alias("details"))
    sinks.append_checks(rows, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").columns == ["run_at", "id", "run_date"]
    with pytest.raises(Exception, match="broken"):
        sinks.append_checks(rows.withColumnRenamed("details", "other"), f"{tmp_path}/d")


def test_sitemaps_by_position(spark):
    xml = "<url><loc>s/1</loc></url><url><loc>s/2</loc><image:image><image:loc>i2</image:loc><image:title> t2 </image:title></image:image></url>"
    df = spark.createDataFrame([(xml,), (None,), ("",)], "text string")
    assert [tuple(r) for r in readers.parse_sitemaps_by_position(df).collect()] == [("1", "s/1", "t2", "i2"), ("2", "s/2", "Unknown Product", None)]


def run_parts(spark, tmp_path, operator, parts, schema, mode, sink):
    """Each part is a file and a run of its own, with the state of the run before."""
    progress = []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in/part={i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        query = operator(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(sink).trigger(availableNow=True).start()
        query.awaitTermination()
        progress.append([p for p in query.recentProgress])
    return progress


def test_late_rows(spark, tmp_path):
    at = lambda hour, minute=0: datetime(2024, 5, 1) + timedelta(hours=hour, minutes=minute)
    row = lambda t, status="pass": (t, "home", status)
    parts = [[row(at(h)) for h in range(6)], [row(at(4, 30), "fail"), row(at(1, 30), "fail"), row(at(9))], [row(at(20))]]
    out = []
    progress = run_parts(spark, tmp_path, lambda s: X.stream_flow_health(s, "1 hour", late="2 hours"), parts, "run_at timestamp, page string, status string", "append", lambda df, _: out.extend(df.collect()))
    got = {r.window_start.hour: (r.total, r.score) for r in out}
    # the row at 4:30 comes late and counts, that at 1:30 comes behind the watermark of 3:00
    assert got == {0: (1, 100), 1: (1, 100), 2: (1, 100), 3: (1, 100), 4: (2, 50), 5: (1, 100), 9: (1, 100)}
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for q in p for o in q["stateOperators"]) == 1


def test_jobs_leave_the_state(spark, tmp_path):
    at = lambda hour: datetime(2024, 5, 1) + timedelta(hours=hour)
    row = lambda job, seq, state, hour: (job, seq, state, seq, at(hour))
    parts = [
        [row(1, 1, "running", 0), row(2, 2, "running", 0), row(2, 3, "done", 0), row(2, 4, "running", 0), row(3, 5, "failed", 0)],
        [row(1, 6, "running", 10)],
        [row(4, 7, "running", 60), row(3, 8, "running", 60)],
        [row(4, 9, "done", 61)],
    ]
    latest = {}

    def sink(df, _):
        latest.update({r.job_id: (r.state, r.progress) for r in df.collect()})

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        progress = run_parts(spark, tmp_path, X.stream_jobs, parts, "job_id long, seq long, state string, progress int, run_at timestamp", "update", sink)
    finally:
        spark.conf.set(store, before)
    rows = [p[-1]["stateOperators"][0]["customMetrics"] for p in progress]
    assert latest == {1: ("running", 6), 2: ("done", 3), 3: ("running", 8), 4: ("done", 9)}
    kept = [p[-1]["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert kept[0] > kept[1] and kept[-1] < kept[0], (kept, rows)


def test_streams_equal_their_batch(spark):
    rows = monitoring_queries.queries()["x4_stream_latest"](spark, SF)
    assert rows.count() == rows.select("page", "metric").distinct().count()


def test_states_are_opened_by_levels(spark):
    states = ['{"id":"","productId":7,"title":"t","price":5.5,"z":[{"id":{"q":1},"name":"n"},{"product_id":"p","productName":"m","sellingPrice":""}]}', "{broken", "[]", "7", "", deep_of(24), deep_of(25), '[[{"id":3,"name":"l"},{"id":3,"name":"l"}]]']
    rows = [(f"u{i}", f'<p><script id="__STATE__">{s}</script>') for i, s in enumerate(states)] + [("none", None), ("no state", "<p>")]
    got = P.deep_state_products(spark.createDataFrame(rows, "url string, html string"))
    want = {("u0", "7", "t", "5.5"), ("u0", "p", "m", None), ("u5", "1", "d", None), ("u7", "3", "l", None)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 5
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "InArrow" not in shown
    assert P.deep_state_products(spark.createDataFrame([], "url string, html string")).collect() == []


def deep_of(levels):
    """A product within so many objects."""
    return '{"y":' * levels + '{"id":1,"name":"d"}' + "}" * levels


@pytest.mark.parametrize("spread_from", [0, 10**9])
def test_components_of_hubs_and_chains(spark, spread_from):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 800)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000 + rng.randrange(90), 5000 + rng.randrange(90)) for _ in range(50)] + [(7000, 7000), (0, 1), (0, 1)]
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(edges, "src long, dst long"), spread_from).collect()}
    want = {x: min(g) for g in groups(edges) for x in g}
    assert got == want
    assert components(spark, spark.createDataFrame([], "src long, dst long"), spread_from).collect() == []


def test_wide_export_is_bounded(spark):
    rows = [(1, [f"u{i}" for i in range(9)], {"a": "b"}), (2, ["x"], None), (3, [], {}), (4, None, {})]
    df = spark.createDataFrame(rows, "id int, images array<string>, specifications map<string,string>")
    got = {r.id: r.asDict() for r in P.wide_export(df, most=3).collect()}
    assert [c for c in got[1] if c.startswith("Image")] == ["Image 1", "Image 2", "Image 3"]
    assert (got[1]["Image 2"], got[1]["Image 3"]) == ("u1", "\n".join(f"u{i}" for i in range(2, 9)))
    assert (got[2]["Image 1"], got[2]["Image 3"], got[3]["Image 1"], got[4]["Image 3"]) == ("x", None, None, None)
    wide = P.wide_export(df)
    assert "Image 9" in wide.columns and "Image 10" not in wide.columns and {r["Image 9"] for r in wide.collect()} == {"u8", None}
