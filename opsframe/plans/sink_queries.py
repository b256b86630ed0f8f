"""Queries that write and read back, and texts made of results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsframe.functions import text as T
from opsframe.operators import duplicates as D
from opsframe.operators import monitoring as M
from opsframe.operators import pages as P
from opsframe.operators.graph import shared_folder
from opsframe.plans.duplicate_queries import _GROUPS
from opsframe.plans.monitoring_queries import _FLOWS, TEMPLATES, _values, rules
from opsframe.plans.page_queries import _product_pages
from opsframe.sources import readers, sinks
from opsframe.sources.adapters import view, with_views
from opsframe.sources.readers import scan


def _path(s, name):
    return f"{shared_folder(s)}/opsframe/{name}-{uuid.uuid4().hex}"


def _appended(s, d):
    checks, path = view(s, d, "check_results_v"), _path(s, "checks")
    sinks.append_checks(checks.where("seq % 2 = 0"), path)
    sinks.append_checks(checks.where("seq % 2 = 1"), path)
    return sinks.read_checks(s, [path]).groupBy(F.col("run_date").cast("string").alias("day")).agg(F.count("*").alias("n"))


def _recent(s, d):
    path = _path(s, "days")
    sinks.append_checks(view(s, d, "check_results_v"), path)
    return sinks.scan_checks(s, path, "2024-01-28 06:00:00", 24).select("seq", "page", "metric", "status")


def _csv(s, d):
    groups, path = D.exact_duplicates(view(s, d, "products_v")), _path(s, "csv")
    sinks.export_csv(groups.select("first_id", F.concat(F.lit('"'), "k_name", F.lit('", x')).alias("name"), F.lit("").alias("blank"), F.col("size").cast("string").alias("size")), path)
    return readers.read_sheet_csv(s, path)


def _json(s, d):
    path = _path(s, "json")
    sinks.export_records_json(view(s, d, "products_v").select("id", "name", "price"), path)
    return readers.read_records_json(s, path, "id string, name string, price string")


def _union(s, d):
    c = view(s, d, "check_results_v")
    parts = {
        "health": c.where("page like 'server%'").select("page", F.lit("response").alias("metric"), F.col("duration_ms").alias("value"), "status"),
        "api": c.where("page like 'api%'").select("page", "metric", "value", "status"),
        "audit": c.where("page = 'home'").select("page", "metric", "value"),
        "flow": c.where("page = 'happy_flow'").select("page", "status"),
        "feature": c.where("page like 'feature%'").select("page", "metric", "status"),
        "monitor": c.agg(F.count("*").alias("value"), F.lit("total").alias("metric")),
    }
    return M.to_check_rows(parts).groupBy("kind").agg(F.count("*").alias("n"), F.count("metric").alias("n_metric"), F.count("value").alias("n_value"), F.count("status").alias("n_status"))


Q = {
    "k5_append_checks": (_appended, "SELECT strftime(run_at, '%Y-%m-%d') AS day, count(*) AS n FROM check_results_v GROUP BY 1"),
    "s14_stored_window": (_recent, "SELECT seq, page, metric, status FROM check_results_v WHERE run_at >= TIMESTAMP '2024-01-28 06:00:00' - INTERVAL 24 HOURS"),
    "k6_s2_csv_round_trip": (_csv, f"WITH {_GROUPS} SELECT first_id, concat('\"', k_name, '\", x') AS name, '' AS blank, CAST(size AS VARCHAR) AS size FROM g"),
    "s3_json_round_trip": (_json, "SELECT id, name, price FROM products_v"),
    "t4_clean_ws": (
        lambda s, d: view(s, d, "products_v").select("id", T.clean_ws(F.concat(F.lit(" ‎a&amp;b&nbsp;  "), "name", F.lit("&#39;s\n"))).alias("text"), T.unescape_html(F.concat("name", F.lit("&eacute;&lt;"))).alias("full")),
        "SELECT id, concat('a&b ', name, chr(39), 's') AS text, concat(name, 'é<') AS full FROM products_v",
    ),
    "t19_report_text": (
        lambda s, d: M.report_text(M.flow_scores(view(s, d, "check_results_v"))),
        f"WITH {_FLOWS} SELECT string_agg(concat(flow, ': ', CAST(score AS VARCHAR), '% (', CASE WHEN score < 60 THEN 'red' WHEN score < 90 THEN 'yellow' ELSE 'green' END, '), ', CAST(n_fail AS VARCHAR), ' failed of ', CAST(total AS VARCHAR)), chr(10) ORDER BY score, flow) AS report FROM flows",
    ),
    "n4_deep_state": (
        lambda s, d: P.deep_state_products(_product_pages(s, d)),
        "SELECT url, CAST(num AS VARCHAR) AS product_id, name, '5' AS price FROM products_v UNION ALL SELECT url, CAST(num AS VARCHAR), 'again', '6' FROM products_v",
    ),
    "n8_merged_causes": (
        lambda s, d: M.merged_causes(view(s, d, "check_results_v"), [*rules(), {"group_key": "home", "group_order": 3, "template_key": "x", "template_order": 0, "summary": "home page view is slow"}]).select("seq", F.array_join("causes", "|").alias("causes")),
        f"WITH t(group_key, group_order, template_key, template_order, summary) AS (VALUES {_values(TEMPLATES)}) SELECT seq, string_agg(summary, '|' ORDER BY group_order, template_order) AS causes FROM check_results_v JOIN t ON contains(page, group_key) GROUP BY seq",
    ),
    "u5_to_check_rows": (
        _union,
        "SELECT CASE WHEN page LIKE 'server%' THEN 'health' WHEN page LIKE 'api%' THEN 'api' WHEN page = 'home' THEN 'audit' WHEN page = 'happy_flow' THEN 'flow' ELSE 'feature' END AS kind, count(*) AS n, count(*) FILTER (page <> 'happy_flow') AS n_metric, count(*) FILTER (page LIKE 'server%' OR page LIKE 'api%' OR page = 'home') AS n_value, count(*) FILTER (page <> 'home') AS n_status FROM check_results_v GROUP BY 1 UNION ALL SELECT 'monitor', 1, 1, 1, 0",
    ),
    "l4_samples": (lambda s, d: scan(s, d, "part").orderBy("p_name", "p_partkey").limit(50).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50"),
}


def queries() -> dict:
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: with_views(sql) for k, (_, sql) in Q.items() if sql}
