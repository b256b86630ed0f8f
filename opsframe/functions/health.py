"""Monitoring rules as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flow_of(page: Column) -> Column:
    return F.when(page.startswith("happy_flow"), "happy_flow").when(page.startswith("feature/"), "feature").when(page.startswith("server/"), "server").when(page.startswith("api/"), "api").otherwise(page)


def status_score(status: Column) -> Column:
    return F.when(status == "pass", 1.0).when(status == "degraded", 0.5).otherwise(0.0)


def colour_of(score: Column) -> Column:
    return F.when(score < 60, "red").when(score < 90, "yellow").otherwise("green")


def platform_of_step(step: Column) -> Column:
    return F.when(step.startswith("mweb_"), "mweb").when(step.startswith("web_"), "web")


def http_status_class(code: Column, ms: Column, error: Column, slow_ms: int = 5000) -> Column:
    return F.when(error.isNotNull(), "fail").when(code >= 500, "fail").when(code >= 400, "degraded").when(ms > slow_ms, "degraded").otherwise("pass")


def budget_status(status: Column, ms: Column, budget_s: Column, mode: str = "reference") -> Column:
    """Over budget is degraded; mode `worst` keeps a fail."""
    over = ms > budget_s * 1000
    return F.when((status == "fail") & F.lit(mode == "worst"), "fail").when(over, "degraded").otherwise(status)


def metric_status(metric: Column, violations: Column) -> Column:
    """fail if any violation text holds the metric's name."""
    return F.when(F.exists(violations, lambda v: F.contains(v, metric)), "fail").otherwise("pass")


def worst_status(status: Column) -> Column:
    """Aggregate: fail over degraded over pass."""
    return F.when(F.bool_or(status == "fail"), "fail").when(F.bool_or(status == "degraded"), "degraded").otherwise("pass")


def value_display(metric: Column, value: Column) -> Column:
    return F.when(metric.endswith("_ms"), F.concat(F.floor(value + 0.5).cast("string"), F.lit("ms"))).when(metric == "cls", F.format_string("%.3f", value)).otherwise(F.floor(value + 0.5).cast("string"))


def step_error(error: Column, reason: Column, detail: Column) -> Column:
    """With a detail: error, else reason, else its first 200 characters; without one: error."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.when(blank(detail).isNotNull(), F.coalesce(blank(error), blank(reason), F.substring(detail, 1, 200))).otherwise(error)
