"""Streams of check results: windowed health, dedup, latest status, alerts, job progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsframe.functions.health import flow_of, status_score
from opsframe.operators.monitoring import KNOWN, rules_of_page


def stream_flow_health(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Per event-time window and flow: total and score; late rows count until the watermark passes."""
    known = stream.where(F.col("status").isin(*KNOWN)).withWatermark("run_at", late)
    span = F.window("run_at", window, slide) if slide else F.window("run_at", window)
    out = known.groupBy(span, flow_of(F.col("page")).alias("flow")).agg(F.count("*").alias("total"), F.bround(F.avg(status_score(F.col("status"))) * 100, 0).cast("long").alias("score"))
    return out.select(F.col("window.start").alias("window_start"), "flow", "total", "score")


def stream_dedup(stream: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("run_at", late).dropDuplicatesWithinWatermark(keys)


def stream_latest(stream: DataFrame) -> DataFrame:
    """Latest status of each (page, metric), for update mode into an upsert."""
    latest = stream.groupBy("page", "metric").agg(F.max(F.struct("run_at", "seq", "status", "value")).alias("r"))
    return latest.select("page", "metric", "r.*")


def stream_alerts(stream: DataFrame, rules: list[dict]) -> DataFrame:
    """fail and degraded rows, once for each rule of their page, or once without one."""
    bad = stream.where(F.col("status").isin("fail", "degraded"))
    met = bad.withColumn("rule", F.explode_outer(rules_of_page(rules, F.col("page"))))
    return met.select(*stream.columns, *(F.col("rule")[c].alias(c) for c in ("group_key", "group_order", "template_key", "template_order", "summary")))


class LatestOfJob(StatefulProcessor):
    """Keeps a job's latest (state, progress) until it ends or falls silent.

    done and failed are final: they stay against any later row while they are kept. A timer in event time
    drops what is kept `keep` ms after a job has ended, or `silence` ms after its last row.
    """

    FINAL = ("done", "failed")

    def __init__(self, keep: int, silence: int):
        self.keep, self.silence = keep, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "state string, progress int, seq long, at long, due long")

    def _due(self, state: str, at: int) -> int:
        return at + (self.keep if state in self.FINAL else self.silence)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.latest.get()
        best = None if kept is None else (kept[0] in self.FINAL, kept[2], kept[0], kept[1], kept[3])
        for part in rows:
            for state, progress, seq, at in zip(part["state"], part["progress"], part["seq"], part["run_at"]):
                here = (state in self.FINAL, int(seq), state, int(progress), int(at.timestamp() * 1000))
                best = here if best is None or here[:2] > best[:2] else best
        _, seq, state, progress, at = best
        due = max(self._due(state, at), timerValues.getCurrentWatermarkInMs() + 1)
        if kept is not None and kept[4] != due:
            self.handle.deleteTimer(kept[4])
        self.handle.registerTimer(due)
        self.latest.update((state, progress, seq, at, due))
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "progress": pd.array([progress], "Int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_jobs(stream: DataFrame, keep: str = "1 hour", silence: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Latest state of each job of (job_id, seq, state, progress, run_at), for update mode into an upsert.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass. A job that sends rows after its
    state was dropped starts anew; until the watermark has passed its end by `keep`, done and failed stay.
    """
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    rows = stream.select("job_id", F.col("seq").cast("long").alias("seq"), "state", F.col("progress").cast("int").alias("progress"), "run_at").withWatermark("run_at", late)
    kind = f"job_id {rows.schema['job_id'].dataType.simpleString()}, state string, progress int"
    return rows.groupBy("job_id").transformWithStateInPandas(LatestOfJob(ms(keep), ms(silence)), kind, "Update", "EventTime")
