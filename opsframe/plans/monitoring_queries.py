"""Monitoring queries over check results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsframe.functions import health as H
from opsframe.operators import catalog, keyed
from opsframe.operators import monitoring as M
from opsframe.operators.graph import shared_folder
from opsframe.sources.adapters import SQL, view, with_views
from opsframe.sources.stored import StoredTable
from opsframe.streaming import checks as X

THRESHOLDS = [("metric_0", ">", 120.0), ("metric_1", ">", 90.0), ("metric_2", "<", 1.0), ("metric_3", ">", 300.0)]
BUDGETS = [("metric_0", 30), ("metric_1", 50), ("metric_4", 2)]
TEMPLATES = [
    ("home", 0, "view", 0, "home page view is slow"),
    ("home", 0, "purchase", 1, "home page purchase is slow"),
    ("api", 1, "timeout", 0, "endpoint times out"),
    ("api", 1, "purchase", 1, "endpoint for purchases is slow"),
    ("server", 2, "signup", 0, "server for sign-ups is slow"),
]


def _checks(s, d):
    return view(s, d, "check_results_v")


def _rules(s, rows, schema):
    return s.createDataFrame(rows, schema)


#: What to do against a cause; the last one has more actions than an alert shows.
ACTIONS = {("home", 0): ["look at the page", "check its images"], ("api", 0): ["raise the timeout"], ("api", 1): ["check the gateway", "check stock", "call the shop", "wait"]}


def rules() -> list[dict]:
    """The templates as rules with actions."""
    names = ("group_key", "group_order", "template_key", "template_order", "summary")
    return [dict(zip(names, t)) | {"actions": ACTIONS.get((t[0], t[3]), [])} for t in TEMPLATES]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _folder(s):
    return f"{shared_folder(s)}/opsframe/stream-{uuid.uuid4().hex}"


def _events(s, d):
    """The events' file as a stream."""
    return s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")


def streamed(s, d, operator, mode: str):
    """The operator on the check results as a stream, in one available-now run; returns what its sink holds."""
    base = _folder(s)
    writer = operator(s.sql(SQL["check_results_v"], events=_events(s, d))).writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    # a complete result replaces the sink's table, an appended one grows it
    writer = writer.foreachBatch(lambda df, _: df.write.mode("append" if mode == "append" else "overwrite").parquet(f"{base}/out"))
    writer.start().awaitTermination()
    return s.read.parquet(f"{base}/out")


def streamed_in_parts(s, d, operator, parts: list[str]):
    """The operator in append mode over parts of the check results that come one after the other, each a condition; rows that come late are in a later part."""
    base, checks = _folder(s), _checks(s, d)
    for i, part in enumerate(parts):
        checks.where(part).write.mode("append").parquet(f"{base}/in/part={i}")
        stream = s.readStream.schema(checks.schema).parquet(f"{base}/in/*")
        writer = operator(stream).writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").format("parquet")
        writer.trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out")


def upserted(s, d, operator, keys: list[str], schema: str, columns: list[str]):
    """The operator in update mode into a stored table, merged batch by batch; returns the table."""
    base = _folder(s)
    stored = StoredTable.create(s, f"{base}/table", s.createDataFrame([], schema), keys, 8)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(store)
    s.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = operator(s.sql(SQL["check_results_v"], events=_events(s, d))).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        writer.foreachBatch(stored.upsert_batch("stream", columns)).start().awaitTermination()
    finally:
        s.conf.set(store, before)
    return stored.read()


#: Parts of the month as they come: before the 10th but for some rows, the days to the 20th with some that are late, all others.
_PARTS = [
    "run_at < '2024-01-10' AND seq % 10 NOT IN (3, 7)",
    "(run_at >= '2024-01-10' AND run_at < '2024-01-20' AND seq % 10 <> 7) OR (run_at < '2024-01-10' AND seq % 10 = 3)",
    "run_at >= '2024-01-20' OR (run_at < '2024-01-20' AND seq % 10 = 7)",
]


_FLOW = """CASE WHEN page LIKE 'happy_flow%' THEN 'happy_flow' WHEN page LIKE 'feature/%' THEN 'feature' WHEN page LIKE 'server/%' THEN 'server' WHEN page LIKE 'api/%' THEN 'api' ELSE page END"""
_FLOWS = f"""flows AS (SELECT {_FLOW} AS flow, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'degraded') AS n_degraded, count(*) FILTER (status = 'fail') AS n_fail,
  count(*) AS total, CAST(round_even(avg(CASE status WHEN 'pass' THEN 1.0 WHEN 'degraded' THEN 0.5 ELSE 0.0 END) * 100, 0) AS BIGINT) AS score
  FROM check_results_v WHERE status IN ('pass','degraded','fail') GROUP BY 1)"""
_ACTIONS = ", ".join(f"('{g}', {t}, '{'; '.join(a[:3])}')" for (g, t), a in ACTIONS.items())
_CAUSE = f"""t(group_key, group_order, template_key, template_order, summary) AS (VALUES {_values(TEMPLATES)}), acts(group_key, template_order, actions) AS (VALUES {_ACTIONS}),
j AS (SELECT c.*, summary, actions FROM check_results_v c LEFT JOIN t ON contains(page, t.group_key) LEFT JOIN acts ON acts.group_key = t.group_key AND acts.template_order = t.template_order
  WHERE status = 'fail' QUALIFY row_number() OVER (PARTITION BY seq ORDER BY CASE WHEN contains(lower(coalesce(step_failed, '')), template_key) THEN 0 ELSE 1 END, group_order, t.template_order) = 1)"""
_FAILURES = f"""{_CAUSE}, f AS (SELECT seq, {_FLOW} AS flow, concat(page, '/', metric, ': ', coalesce(step_failed, 'missing'), chr(10), '  RCA: ', coalesce(summary, 'generic'), chr(10), '  Actions: ', coalesce(actions, '')) AS text FROM j)"""
_KEYED = "keyed AS (SELECT *, coalesce(run_id, strftime(run_at, '%Y-%m-%d %H:%M:%S')) AS run_key FROM check_results_v)"

Q = {
    "a5_flow_scores": (
        lambda s, d: M.flow_scores(_checks(s, d)),
        f"WITH {_FLOWS} SELECT *, CASE WHEN score < 60 THEN 'red' WHEN score < 90 THEN 'yellow' ELSE 'green' END AS colour FROM flows",
    ),
    "a6_overall_health": (
        lambda s, d: M.overall_health(M.flow_scores(_checks(s, d))),
        f"WITH {_FLOWS} SELECT CAST(coalesce(round_even(sum(score * total) / sum(total), 0), 0) AS BIGINT) AS overall, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, count(*) FILTER (score < 60) AS not_in_order FROM flows",
    ),
    "a7_failing_details": (
        lambda s, d: M.failing_details(_checks(s, d), M.flow_scores(_checks(s, d))),
        f"WITH {_FLOWS} SELECT seq, {_FLOW} AS flow, regexp_replace(page, '^(server|api|feature)/', '') AS page, metric, substr(step_failed, 1, 100) AS error FROM check_results_v WHERE status = 'fail' AND {_FLOW} IN (SELECT flow FROM flows WHERE score < 60)",
    ),
    "a8_latest_run_summary": (
        lambda s, d: M.latest_run_summary(_checks(s, d)),
        f"WITH {_KEYED}, newest AS (SELECT run_key FROM keyed ORDER BY run_at DESC, seq DESC LIMIT 1) SELECT count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'degraded') AS n_degraded, count(*) FILTER (status = 'fail') AS n_fail, (SELECT count(DISTINCT run_key) FROM keyed) AS n_runs FROM keyed WHERE run_key IN (SELECT run_key FROM newest)",
    ),
    "a9_rollup_status": (
        lambda s, d: M.rollup_status(_checks(s, d).withColumn("day", F.date_format("run_at", "yyyy-MM-dd")), "day"),
        "SELECT strftime(run_at, '%Y-%m-%d') AS day, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'pass' END AS status, count(*) AS n FROM check_results_v GROUP BY 1",
    ),
    "a13_outcome_counts": (
        lambda s, d: _checks(s, d).groupBy("status").agg(F.count("*").alias("n")),
        "SELECT status, count(*) AS n FROM check_results_v GROUP BY 1",
    ),
    "a16_alert_digest": (
        lambda s, d: M.alert_digest(_checks(s, d), rules()),
        f"WITH {_FAILURES}, r AS (SELECT flow, text, row_number() OVER (PARTITION BY flow ORDER BY seq) AS k FROM f) SELECT flow, count(*) AS n_failed, string_agg(text, chr(10) ORDER BY k) FILTER (k <= 3) AS texts FROM r GROUP BY flow",
    ),
    "a16_alert_failures": (lambda s, d: M.alert_failures(_checks(s, d), rules()), f"WITH {_FAILURES} SELECT seq, flow, text FROM f"),
    "a17_flow_overall_last": (
        lambda s, d: M.flow_overall(_checks(s, d), "last"),
        f"SELECT {_FLOW} AS flow, coalesce(arg_max(status, seq) FILTER (status <> 'pass'), 'pass') AS status FROM check_results_v WHERE status IN ('pass','degraded','fail') GROUP BY 1",
    ),
    "a17_flow_overall_worst": (
        lambda s, d: M.flow_overall(_checks(s, d), "worst"),
        f"SELECT {_FLOW} AS flow, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'pass' END AS status FROM check_results_v WHERE status IN ('pass','degraded','fail') GROUP BY 1",
    ),
    "w3_latest_per_metric": (
        lambda s, d: M.latest_per_metric(_checks(s, d)).select("page", "metric", "seq", "status"),
        "SELECT page, metric, seq, status FROM check_results_v QUALIFY row_number() OVER (PARTITION BY page, metric ORDER BY run_at DESC, seq) = 1",
    ),
    "w3_latest_per_step": (
        lambda s, d: M.latest_per_step(_checks(s, d)).select("metric", "seq", "status"),
        "SELECT metric, seq, status FROM check_results_v QUALIFY row_number() OVER (PARTITION BY metric ORDER BY run_at, seq DESC) = 1",
    ),
    "w4_latest_value": (
        lambda s, d: M.latest_value(_checks(s, d)),
        "SELECT page, metric, value, status, seq FROM check_results_v QUALIFY row_number() OVER (PARTITION BY page, metric ORDER BY run_at DESC, seq DESC) = 1",
    ),
    "w9_first_errors": (
        lambda s, d: M.first_errors(_checks(s, d), 5),
        "SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY seq) AS INTEGER) AS rank, step_failed FROM check_results_v WHERE step_failed IS NOT NULL QUALIFY rank <= 5",
    ),
    "s13_latest_rows": (
        lambda s, d: keyed.latest_rows(_checks(s, d), 600).select("seq", "page", "status"),
        "SELECT seq, page, status FROM check_results_v ORDER BY run_at DESC, seq LIMIT 600",
    ),
    "s14_window_scan": (
        lambda s, d: keyed.window_scan(_checks(s, d), "2024-01-10 00:00:00", 24).select("seq", "page", "metric", "status"),
        "SELECT seq, page, metric, status FROM check_results_v WHERE run_at >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 24 HOURS",
    ),
    "k10_retain_latest": (
        lambda s, d: M.retain_latest(_checks(s, d), 24, "page").select("page", "seq", "rank"),
        "SELECT page, seq, CAST(row_number() OVER (PARTITION BY page ORDER BY run_at DESC, seq DESC) AS INTEGER) AS rank FROM check_results_v QUALIFY rank <= 24",
    ),
    "m15_http_status_class": (
        lambda s, d: _checks(s, d).select("seq", H.http_status_class((200 + F.col("seq") % 7 * 60).cast("int"), F.col("duration_ms"), F.when(F.col("seq") % 50 == 0, "timeout")).alias("status")),
        "SELECT seq, CASE WHEN seq % 50 = 0 THEN 'fail' WHEN 200 + seq % 7 * 60 >= 500 THEN 'fail' WHEN 200 + seq % 7 * 60 >= 400 THEN 'degraded' WHEN duration_ms > 5000 THEN 'degraded' ELSE 'pass' END AS status FROM check_results_v",
    ),
    "m16_threshold_violations": (
        lambda s, d: M.threshold_violations(_checks(s, d).groupBy("page", "metric").agg(F.max("value").alias("value")), _rules(s, THRESHOLDS, "metric string, op string, bound double")).select("page", "status", F.size("violations").cast("long").alias("n_violations")),
        f"WITH m AS (SELECT page, metric, max(value) AS value FROM check_results_v GROUP BY 1, 2), t(metric, op, bound) AS (VALUES {_values(THRESHOLDS)}), b AS (SELECT page, m.metric, coalesce((op = '<' AND value < bound) OR (op = '>' AND value > bound), false) AS broken FROM m LEFT JOIN t ON m.metric = t.metric) SELECT page, CASE WHEN bool_or(broken) THEN 'degraded' ELSE 'pass' END AS status, count(DISTINCT metric) FILTER (broken) AS n_violations FROM b GROUP BY page",
    ),
    "m17_budget_status": (
        lambda s, d: M.apply_budgets(_checks(s, d), _rules(s, BUDGETS, "metric string, budget_s int")),
        f"WITH b(metric, budget_s) AS (VALUES {_values(BUDGETS)}) SELECT seq, c.metric, CASE WHEN duration_ms > budget_s * 1000 THEN 'degraded' ELSE status END AS status FROM check_results_v c LEFT JOIN b ON c.metric = b.metric",
    ),
    "m18_metric_status": (
        lambda s, d: _checks(s, d).select("seq", H.metric_status(F.col("metric"), F.array(F.lit("metric_1 > 90"), F.lit("metric_3 > 300"))).alias("status")),
        "SELECT seq, CASE WHEN metric IN ('metric_1', 'metric_3') THEN 'fail' ELSE 'pass' END AS status FROM check_results_v",
    ),
    "m19_status_score": (
        lambda s, d: _checks(s, d).select("seq", H.status_score(F.col("status")).alias("score")),
        "SELECT seq, CASE status WHEN 'pass' THEN 1.0::DOUBLE WHEN 'degraded' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM check_results_v",
    ),
    "m20_value_display": (
        lambda s, d: _checks(s, d).select("seq", H.value_display(F.when(F.col("seq") % 3 == 0, "lcp_ms").when(F.col("seq") % 3 == 1, "cls").otherwise("score"), F.col("value")).alias("shown")),
        "SELECT seq, CASE seq % 3 WHEN 0 THEN concat(CAST(CAST(floor(value + 0.5) AS BIGINT) AS VARCHAR), 'ms') WHEN 1 THEN printf('%.3f', value) ELSE CAST(CAST(floor(value + 0.5) AS BIGINT) AS VARCHAR) END AS shown FROM check_results_v",
    ),
    "n9_step_error": (
        lambda s, d: _checks(s, d).select("seq", H.step_error(F.col("step_failed"), F.when(F.col("seq") % 2 == 0, "reason"), F.when(F.col("seq") % 3 == 0, F.col("page"))).alias("error")),
        "SELECT seq, CASE WHEN seq % 3 = 0 THEN coalesce(step_failed, CASE WHEN seq % 2 = 0 THEN 'reason' END, page) ELSE step_failed END AS error FROM check_results_v",
    ),
    "t16_flow_of": (
        lambda s, d: _checks(s, d).groupBy("page", H.flow_of(F.col("page")).alias("flow")).agg(F.count("*").alias("n")),
        f"SELECT page, {_FLOW} AS flow, count(*) AS n FROM check_results_v GROUP BY 1, 2",
    ),
    "t17_platform_of_step": (
        lambda s, d: _checks(s, d).select("seq", H.platform_of_step(F.concat(F.when(F.col("seq") % 3 == 0, "mweb_").when(F.col("seq") % 3 == 1, "web_").otherwise(""), F.col("page"))).alias("platform")),
        "SELECT seq, CASE seq % 3 WHEN 0 THEN 'mweb' WHEN 1 THEN 'web' END AS platform FROM check_results_v",
    ),
    "j13_root_cause": (
        lambda s, d: M.root_cause(_checks(s, d).where("status = 'fail'"), rules()),
        f"WITH t(group_key, group_order, template_key, template_order, summary) AS (VALUES {_values(TEMPLATES)}), j AS (SELECT seq, page, summary, row_number() OVER (PARTITION BY seq ORDER BY CASE WHEN contains(lower(coalesce(step_failed, '')), template_key) THEN 0 ELSE 1 END, group_order, template_order) AS k FROM check_results_v c LEFT JOIN t ON contains(page, group_key) WHERE status = 'fail') SELECT seq, page, coalesce(summary, 'generic') AS summary FROM j WHERE k = 1",
    ),
    "f13_check_constraints": (
        lambda s, d: catalog.check_constraints(_checks(s, d), ["run_id", "page", "step_failed"], {"status": ["pass", "fail", "degraded"]}, ["metric", "page"]),
        "SELECT 'not_null:run_id' AS rule, count(*) FILTER (run_id IS NULL) AS n FROM check_results_v UNION ALL SELECT 'not_null:page', count(*) FILTER (page IS NULL) FROM check_results_v UNION ALL SELECT 'not_null:step_failed', count(*) FILTER (step_failed IS NULL) FROM check_results_v UNION ALL SELECT 'enum:status', count(*) FILTER (status NOT IN ('pass','fail','degraded')) FROM check_results_v UNION ALL SELECT 'unique:metric,page', count(*) FROM (SELECT 1 FROM check_results_v GROUP BY metric, page HAVING count(*) > 1)",
    ),
    "u6_unpivot_metrics": (
        lambda s, d: M.unpivot_metrics(_checks(s, d).select("seq", "value", F.when(F.col("seq") % 2 == 0, F.col("duration_ms").cast("double")).alias("duration")), ["seq"], ["value", "duration"]).withColumnRenamed("value", "v"),
        "SELECT seq, 'value' AS metric, value AS v FROM check_results_v UNION ALL SELECT seq, 'duration', CAST(duration_ms AS DOUBLE) FROM check_results_v WHERE seq % 2 = 0",
    ),
    "x1_stream_flow_health": (
        lambda s, d: streamed_in_parts(s, d, lambda c: X.stream_flow_health(c, "1 hour", late="2 hours"), _PARTS).select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "flow", "total", "score"),
        f"""WITH p AS (SELECT *, CASE WHEN {_PARTS[0].replace("'2024", "TIMESTAMP '2024")} THEN 0 WHEN {_PARTS[1].replace("'2024", "TIMESTAMP '2024")} THEN 1 ELSE 2 END AS part, date_trunc('hour', run_at) AS h FROM check_results_v WHERE status IN ('pass','degraded','fail')),
w AS (SELECT part, max(run_at) - INTERVAL 2 HOURS AS mark FROM p GROUP BY part),
k AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.part < p.part AND p.h + INTERVAL 1 HOUR <= w.mark))
SELECT strftime(h, '%Y-%m-%d %H') AS hour, {_FLOW} AS flow, count(*) AS total, CAST(round_even(avg(CASE status WHEN 'pass' THEN 1.0 WHEN 'degraded' THEN 0.5 ELSE 0.0 END) * 100, 0) AS BIGINT) AS score
FROM k WHERE h + INTERVAL 1 HOUR <= (SELECT max(mark) FROM w) GROUP BY 1, 2""",
    ),
    "x2_stream_daily": (
        lambda s, d: streamed(s, d, lambda c: X.stream_flow_health(c, "24 hours", "1 hour"), "complete").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("start"), "flow", "total", "score"),
        f"WITH w AS (SELECT *, unnest(range(24)) AS back FROM check_results_v WHERE status IN ('pass','degraded','fail')) SELECT strftime(date_trunc('hour', run_at) - back * INTERVAL 1 HOUR, '%Y-%m-%d %H') AS start, {_FLOW} AS flow, count(*) AS total, CAST(round_even(avg(CASE status WHEN 'pass' THEN 1.0 WHEN 'degraded' THEN 0.5 ELSE 0.0 END) * 100, 0) AS BIGINT) AS score FROM w GROUP BY 1, 2",
    ),
    "x3_stream_dedup": (
        lambda s, d: streamed(s, d, lambda c: X.stream_dedup(c.unionByName(c), ["seq"], "40 days"), "append").select("seq", "page", "metric", "status"),
        "SELECT seq, page, metric, status FROM check_results_v",
    ),
    "x4_stream_latest": (
        lambda s, d: upserted(s, d, X.stream_latest, ["page", "metric"], "page string, metric string, run_at timestamp, seq long, status string, value double", ["run_at", "seq", "status", "value"]).select("page", "metric", "seq", "status"),
        "SELECT page, metric, seq, status FROM check_results_v QUALIFY row_number() OVER (PARTITION BY page, metric ORDER BY run_at DESC, seq DESC) = 1",
    ),
    "x5_stream_alerts": (
        lambda s, d: streamed(s, d, lambda c: X.stream_alerts(c, rules()), "append").select("seq", "status", "summary"),
        f"WITH t(group_key, group_order, template_key, template_order, summary) AS (VALUES {_values(TEMPLATES)}) SELECT seq, status, summary FROM check_results_v c LEFT JOIN t ON contains(page, group_key) WHERE status IN ('fail', 'degraded')",
    ),
    "x6_stream_jobs": (
        lambda s, d: upserted(s, d, lambda c: X.stream_jobs(c.select((F.col("seq") % 50).alias("job_id"), "seq", F.when(F.col("seq") % 7 == 0, "done").otherwise("running").alias("state"), F.col("duration_ms").alias("progress"), "run_at")), ["job_id"], "job_id long, state string, progress int", ["state", "progress"]),
        "SELECT seq % 50 AS job_id, CASE WHEN seq % 7 = 0 THEN 'done' ELSE 'running' END AS state, duration_ms AS progress FROM check_results_v QUALIFY row_number() OVER (PARTITION BY seq % 50 ORDER BY CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END DESC, seq DESC) = 1",
    ),
    "a15_catalog_count": (lambda s, d: _checks(s, d).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM check_results_v"),
}


def queries() -> dict:
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: with_views(sql) for k, (_, sql) in Q.items() if sql}
