"""Synthetic-monitoring results: flow health, latest status, causes, alerts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.health import colour_of, flow_of, status_score, worst_status
from opsframe.functions.scores import let
from opsframe.operators.keyed import top_per_key

KNOWN = ("pass", "degraded", "fail")


def flow_scores(checks: DataFrame) -> DataFrame:
    """Per flow: counts, score (half-even percent) and colour; unknown statuses are dropped."""
    known = checks.where(F.col("status").isin(*KNOWN))
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in KNOWN]
    per = known.groupBy(flow_of(F.col("page")).alias("flow")).agg(*counts, F.count("*").alias("total"), F.bround(F.avg(status_score(F.col("status"))) * 100, 0).cast("long").alias("score"))
    return per.withColumn("colour", colour_of(F.col("score")))


def _health() -> list[Column]:
    return [
        F.coalesce(F.bround(F.sum(F.col("score") * F.col("total")) / F.sum("total"), 0).cast("long"), F.lit(0)).alias("overall"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
    ]


def overall_health(flows: DataFrame) -> DataFrame:
    """Mean of the rounded flow scores weighted by their totals, 0 if there are none; flows below 60."""
    return flows.agg(*_health(), F.count_if(F.col("score") < 60).alias("not_in_order"))


def failing_details(checks: DataFrame, flows: DataFrame) -> DataFrame:
    bad = flows.where("score < 60").select("flow")
    fails = checks.where("status = 'fail'").withColumn("flow", flow_of(F.col("page")))
    return fails.join(bad, "flow", "left_semi").select("seq", "flow", F.regexp_replace("page", "^(server|api|feature)/", "").alias("page"), "metric", F.substring("step_failed", 1, 100).alias("error"))


def run_key():
    return F.coalesce("run_id", F.date_format("run_at", "yyyy-MM-dd HH:mm:ss"))


def latest_run(checks: DataFrame) -> DataFrame:
    """Rows of the run of the newest check; ties to the greater seq."""
    keyed = checks.withColumn("run_key", run_key())
    newest = keyed.agg(F.max_by("run_key", F.struct("run_at", "seq")).alias("run_key"))
    # one row
    return keyed.join(F.broadcast(newest), "run_key", "left_semi")


def latest_run_summary(checks: DataFrame) -> DataFrame:
    names = [f"n_{s}" for s in KNOWN] + ["n_runs"]
    n_runs = checks.select(run_key().alias("k")).agg(F.countDistinct("k").alias("n_runs"))
    counts = latest_run(checks).agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in KNOWN))
    return counts.unionByName(n_runs, allowMissingColumns=True).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))


def rollup_status(checks: DataFrame, by: str) -> DataFrame:
    return checks.groupBy(by).agg(worst_status(F.col("status")).alias("status"), F.count("*").alias("n"))


def latest_per_metric(checks: DataFrame) -> DataFrame:
    """Newest row of each (page, metric); ties to the smaller seq."""
    return top_per_key(checks, ["page", "metric"], [F.desc("run_at"), F.col("seq")], 1)


def latest_per_step(checks: DataFrame) -> DataFrame:
    """The last of each metric in the same order: the opposite rule."""
    return top_per_key(checks, ["metric"], [F.col("run_at"), F.desc("seq")], 1)


def latest_value(checks: DataFrame) -> DataFrame:
    return checks.groupBy("page", "metric").agg(F.max_by(F.struct("value", "status", "seq"), F.struct("run_at", "seq")).alias("r")).select("page", "metric", "r.*")


def retain_latest(df: DataFrame, n: int, by: str) -> DataFrame:
    return top_per_key(df, [by], [F.desc("run_at"), F.desc("seq")], n)


def flow_overall(checks: DataFrame, mode: str = "worst") -> DataFrame:
    """Per flow the worst status, or the last that isn't pass."""
    tagged = checks.where(F.col("status").isin(*KNOWN)).withColumn("flow", flow_of(F.col("page")))
    last = F.coalesce(F.max_by(F.when(F.col("status") != "pass", F.col("status")), F.when(F.col("status") != "pass", F.col("seq"))), F.lit("pass"))
    return tagged.groupBy("flow").agg((worst_status(F.col("status")) if mode == "worst" else last).alias("status"))


#: Rules and actions are constants of the plan; so many rules at most.
MOST_RULES = 1000
_RULE = "array<struct<group_order:int,template_order:int,group_key:string,template_key:string,summary:string,actions:array<string>>>"


def rules_of_page(rules: list[dict], page: Column) -> Column:
    """The rules (group_key, group_order, template_key, template_order, summary, actions) whose group is in the page, in their order.

    All rules are one constant that each row is matched against in place: there is no join and no shuffle.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than a plan should hold as a constant; at most {MOST_RULES}")
    named = [{"actions": [], **r} for r in rules]
    order = ("group_order", "template_order", "group_key", "template_key", "summary", "actions")
    constant = F.from_json(F.lit(json.dumps([{c: r[c] for c in order} for r in sorted(named, key=lambda r: (r["group_order"], r["template_order"]))])), _RULE)
    return F.coalesce(F.filter(constant, lambda r: F.contains(page, r["group_key"])), F.from_json(F.lit("[]"), _RULE))


def _cause(rules: list[dict], page: Column, text: Column) -> Column:
    """The first rule of the page whose key is in the text, else the page's first rule, else null."""

    def pick(met: Column) -> Column:
        exact = F.filter(met, lambda r: F.contains(F.lower(F.coalesce(text, F.lit(""))), r["template_key"]))
        return F.coalesce(F.get(exact, F.lit(0)), F.get(met, F.lit(0)))

    return let(rules_of_page(rules, page), pick)


def root_cause(checks: DataFrame, rules: list[dict]) -> DataFrame:
    """seq, page, summary: of the first rule whose group is in the page and key in the text; else the group's first; else `generic`."""
    return checks.select("seq", "page", F.coalesce(_cause(rules, F.col("page"), F.col("step_failed"))["summary"], F.lit("generic")).alias("summary"))


def alert_failures(checks: DataFrame, rules: list[dict], actions: int = 3) -> DataFrame:
    """seq, flow, text of each failure: what failed, the cause and the first actions against it."""
    fails = checks.where("status = 'fail'").withColumns({"flow": flow_of(F.col("page")), "cause": _cause(rules, F.col("page"), F.col("step_failed"))})
    what = F.concat(F.col("page"), F.lit("/"), F.col("metric"), F.lit(": "), F.coalesce("step_failed", F.lit("missing")))
    why = F.concat(F.lit("\n  RCA: "), F.coalesce(F.col("cause.summary"), F.lit("generic")))
    then = F.concat(F.lit("\n  Actions: "), F.coalesce(F.array_join(F.slice("cause.actions", 1, actions), "; "), F.lit("")))
    return fails.select("seq", "flow", F.concat(what, why, then).alias("text"))


def alert_digest(checks: DataFrame, rules: list[dict], shown: int = 3) -> DataFrame:
    """Per flow the number of failures, and the first of them with their causes and actions."""
    fails = alert_failures(checks, rules)
    first = top_per_key(fails, ["flow"], [F.col("seq")], shown).groupBy("flow").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("texts"))
    return fails.groupBy("flow").agg(F.count("*").alias("n_failed")).join(first, "flow", "left")


def apply_budgets(checks: DataFrame, budgets: DataFrame) -> DataFrame:
    from opsframe.functions.health import budget_status

    j = checks.join(budgets, "metric", "left")
    return j.select("seq", "metric", F.coalesce(budget_status(F.col("status"), F.col("duration_ms"), F.col("budget_s")), F.col("status")).alias("status"))


def threshold_violations(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """page, status, violations: strict comparisons, a missing metric passes. thresholds: (metric, op, bound)."""
    j = metrics.join(thresholds, "metric", "left")
    broken = ((F.col("op") == "<") & (F.col("value") < F.col("bound"))) | ((F.col("op") == ">") & (F.col("value") > F.col("bound")))
    text = F.when(broken, F.concat_ws(" ", "metric", "op", F.col("bound").cast("string")))
    return j.groupBy("page").agg(F.when(F.bool_or(F.coalesce(broken, F.lit(False))), "degraded").otherwise("pass").alias("status"), F.sort_array(F.collect_set(text)).alias("violations"))


def first_errors(checks: DataFrame, n: int) -> DataFrame:
    """The first n error texts of each page, in order."""
    return top_per_key(checks.where("step_failed is not null"), ["page"], [F.col("seq")], n).select("page", "rank", "step_failed")


def unpivot_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(ids, metrics, "metric", "value").where("value is not null")


def substep_status(steps: DataFrame) -> DataFrame:
    """All sub-steps pass: pass, else degraded."""
    return steps.withColumn("status", F.when(F.forall("sub_steps", lambda s: s["status"] == "pass"), "pass").otherwise("degraded"))


def checkout_status(steps: DataFrame, gateway: str = "gateway") -> DataFrame:
    """status and reason of a checkout, of its sub-steps (check, status) and whether the payment gateway was seen; null counts as unseen."""
    has = lambda check, status: F.coalesce(F.exists("sub_steps", lambda s: (s["check"] == check) & (s["status"] == status)), F.lit(False))
    paid, waiting = has("pay_button_click", "pass"), has("bargain_state", "degraded")
    done = F.coalesce(F.col(gateway), F.lit(False)) & paid
    status = F.when(done, "pass").when(waiting | paid, "degraded").otherwise("fail")
    reason = F.when(done, F.lit(None)).when(waiting, "bargain in progress").when(paid, "gateway not detected").otherwise("no pay button")
    return steps.withColumns({"status": status, "reason": reason})


def evaluate_checks(obs: DataFrame) -> DataFrame:
    """visible, count at least min, text contains, attribute equals."""
    kind = F.col("check_type")
    ok = F.when(kind == "visible", F.col("visible")).when(kind == "count", F.col("match_count") >= F.col("min")).when(kind == "text", F.contains("text", F.col("expected"))).when(kind == "attr", F.col("attr") == F.col("expected"))
    return obs.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail"))


def attach_recording(steps: DataFrame) -> DataFrame:
    """Each step with the first recording of its platform."""
    from opsframe.functions.health import platform_of_step

    s = steps.withColumn("platform", platform_of_step(F.col("step")))
    first = s.where("video_path is not null").groupBy("platform").agg(F.min_by("video_path", "seq").alias("recording"))
    return s.join(first, "platform", "left")


def to_check_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """One long table out of checks of several kinds: page, metric, value, status; a kind lacks what it has no column for."""
    out = None
    for kind, df in parts.items():
        have = lambda c, t: (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)  # noqa: B023, E731
        rows = df.select(F.lit(kind).alias("kind"), have("page", "string"), have("metric", "string"), have("value", "double"), have("status", "string"))
        out = rows if out is None else out.unionByName(rows)
    return out


def report_text(flows: DataFrame) -> DataFrame:
    """One text: flows by score, each as a line."""
    line = F.format_string("%s: %d%% (%s), %d failed of %d", "flow", "score", "colour", "n_fail", "total")
    rows = F.sort_array(F.collect_list(F.struct("score", "flow", line.alias("line"))))
    return flows.agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("report"))


# Signs of the colours.
ICONS = {"green": "✅", "yellow": "🟡", "red": "🔴"}


def _flow_lines(flows: DataFrame, shown: str, broken: str) -> DataFrame:
    """overall, total, shown and broken: a line a flow, and a line for each flow below 60, worst first. There is one row a flow."""
    icon = F.coalesce(*(F.when(F.col("colour") == c, i) for c, i in ICONS.items()), F.lit("⚪"))
    named = flows.withColumn("icon", icon).withColumns({"shown": F.format_string(shown, "icon", "flow", "score", "n_pass", "n_degraded", "n_fail"), "broken": F.format_string(broken, "flow", "n_fail", "total")})
    lines = F.sort_array(F.collect_list(F.struct("score", "flow", "shown", "broken")))
    return named.agg(*_health(), F.transform(lines, lambda r: r["shown"]).alias("shown"), F.transform(F.filter(lines, lambda r: r["score"] < 60), lambda r: r["broken"]).alias("broken"))


def chat_report(flows: DataFrame, hours: int = 24) -> DataFrame:
    """One message: overall score, a line a flow, flows out of order."""
    f = _flow_lines(flows, "%s %s: %d/100 (P%d/D%d/F%d)", "   • %s — %d failing")
    head = F.array(F.format_string("📊 *Daily Health Summary — %d/100*", "overall"), F.format_string(f"_Window: last {hours}h · %d checks_", "total"), F.lit(""))
    tail = F.when(F.size("broken") > 0, F.concat(F.array(F.lit(""), F.lit("⚠️ *Not in order:*")), F.col("broken"))).otherwise(F.array().cast("array<string>"))
    return f.select(F.array_join(F.concat(head, F.col("shown"), tail), "\n").alias("message"))


def mail_report(flows: DataFrame, title: str, generated_at: str, hours: int = 24) -> DataFrame:
    """One body: overall score, a line a flow, a line for each flow out of order. failing_details has the checks behind those."""
    f = _flow_lines(flows, "%s %s: %d/100 (pass %d / degraded %d / fail %d)", "🔴 %s — %d failing of %d checks")
    rule = lambda sign: F.lit(sign * 50)
    head = F.array(F.lit(title), rule("="), F.lit(f"Generated: {generated_at}"), F.lit(f"Window: last {hours}h"), F.format_string("Total checks: %d", "total"), F.format_string("Overall health score: %d/100", "overall"), F.lit(""), F.lit("PER-FLOW SCORES"), rule("-"))
    none = F.array(F.lit("No flows are consistently failing today."))
    tail = F.concat(F.array(F.lit(""), F.lit("NOT IN ORDER (failing even when average is OK)"), rule("-")), F.when(F.size("broken") > 0, F.col("broken")).otherwise(none))
    return f.select(F.array_join(F.concat(head, F.col("shown"), tail), "\n").alias("body"))


def cause_text(name: Column, summary: Column, severity: Column, errors: Column, causes: Column, actions: Column) -> Column:
    """A chat message of a root cause: at most three console errors of 100 characters, all causes and actions. Null lists count as empty."""
    none = F.array().cast("array<string>")
    items = lambda c: F.transform(F.coalesce(c, none), lambda x: F.concat(F.lit("• "), x))
    head = F.array(F.concat(F.lit("🔍 *RCA: "), name, F.lit("*")), F.concat(F.lit("📋 *Summary:* "), summary), F.concat(F.lit("⚠️ *Severity:* "), F.upper(severity)))
    seen = F.when(F.size(errors) > 0, F.concat(F.array(F.format_string("🖥️ *Console Errors (%d):*", F.size(errors))), F.transform(F.slice(errors, 1, 3), lambda e: F.concat(F.lit("   `"), F.substring(e, 1, 100), F.lit("`")))))
    return F.array_join(F.concat(head, F.coalesce(seen, none), F.array(F.lit("\n*🔧 Probable Causes:*")), items(causes), F.array(F.lit("\n*✅ Action Items:*")), items(actions)), "\n")


def merged_causes(checks: DataFrame, rules: list[dict]) -> DataFrame:
    """seq, causes: texts of all rules of the page, repeated ones once, in the rules' order; pages without a rule are left out."""
    causes = F.array_distinct(F.transform(rules_of_page(rules, F.col("page")), lambda r: r["summary"]))
    return checks.select("seq", causes.alias("causes")).where(F.size("causes") > 0)
