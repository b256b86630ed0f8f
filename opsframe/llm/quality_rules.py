"""Quality rules: fixed limits, then robust multivariate outliers.

Each text becomes a vector of transformed statistics. Per language and source, the
minimum covariance determinant estimate of its centre and scatter is sought by
C-steps over all rows: keep the H share of rows nearest in Mahalanobis distance,
take their mean and covariance, repeat until no group's estimate changes (STEPS
times at most). Each group has two starts, medians with scaled quartile ranges and
the classical mean with its covariance; the one that ends in the least determinant
counts. A row whose squared distance to its group's estimate passes CUTOFF is
rejected. Groups of fewer than MIN_GROUP rows, too few for seven dimensions, use
their language's estimate over all its sources, and languages of fewer than that
the estimate of all rows.

Statistics are whole numbers in units of 1 / SCALE, quantiles are exact ones of
counts by value, and the nearest rows are taken by whole steps of distance (1 /
NEAR of its binary logarithm), so estimates do not depend on how rows are dealt.
Shares are smoothed by pseudo-counts, and the scatter has a floor, so that groups
in which a statistic hardly varies don't reject every small deviation.

Defined cases: null text has no words; such rows fail the base limits (n_words <
10) and take no part in the estimates; null lang or source are groups of their
own; repeated rows each count and each get a row; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.llm.common import materialize, sliced

FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "marks", "upper", "digits")
SCALE = 1024
#: Least standard deviation of each statistic, in units of the statistic.
FLOOR = (0.06, 0.03, 0.08, 0.08, 0.03, 0.06, 0.06)
H = 0.75
STEPS = 12
MIN_GROUP = 100
NEAR = 32


def chi_square(x: float, degrees: int) -> float:
    """Distribution function of chi-square with an odd number of degrees."""
    total, term = 0.0, 1.0
    for k in range(1, degrees - 1, 2):
        total, term = total + term, term * x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < share else (low, mid)
    return high


#: Squared distance that one in 10,000 rows of a normal distribution passes.
CUTOFF = chi_square_quantile(0.9999, len(FEATURES))
#: What the covariance of the nearest H share of a normal distribution falls short by.
CONSISTENCY = H / chi_square(chi_square_quantile(H, len(FEATURES)), len(FEATURES) + 2)

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARK = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_BLANK = " \t\n\x0b\x0c\r"
# The symbols that the base limits count.
_SYMBOLS = "#*$%&|<>"

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in 5-word windows found twice or more, first ones included; windows of equal hashes are compared word by word."""
    n = len(words) - 4
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for i in range(5):
        w = (w ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        w ^= w >> np.uint64(31)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    left, right = order[:-1][same], order[1:][same]
    twice = np.zeros(n, np.int64)
    if all(words[i : i + 5] == words[j : j + 5] for i, j in zip(left.tolist(), right.tolist())):
        twice[left] = twice[right] = 1
    else:  # two windows share a hash
        places: dict[tuple, list[int]] = {}
        for i in range(n):
            places.setdefault(tuple(words[i : i + 5]), []).append(i)
        twice[[i for at in places.values() if len(at) > 1 for i in at]] = 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 5, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple[list[int], list[int]]:
    """The five counts and the transformed statistics."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # the six blanks of ASCII
    chars = len(text) - sum(map(text.count, _BLANK))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup, n = len(lines) - len(set(lines)), len(words)
    repeats = repeated_words(words)
    share = lambda delete: len(raw) - len(raw.translate(None, delete))
    vector = (
        4 * np.log((chars + 120) / (n + 20)),
        np.sqrt((symbols + 1) / (chars + 100)),
        np.sqrt((dup + 0.5) / (len(lines) + 10)),
        np.sqrt((repeats + 1) / (n + 50)),
        np.sqrt((share(_MARK) + 4) / (chars + 100)),
        np.sqrt((share(_UPPER) + 3) / (chars + 100)),
        np.sqrt((share(_DIGIT) + 1) / (chars + 100)),
    )
    return [n, chars, symbols, dup, repeats], [round(SCALE * float(x)) for x in vector]


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, then the counts and x0.. (long)."""
    names = [*_COUNTS, *(f"x{i}" for i in range(len(FEATURES)))]
    source = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = np.array([sum(text_stats(t), []) for t in batch.column(len(keep)).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(rows[:, i]) for i in range(len(names)))], [*keep, *names])

    counts = [T.StructField(n, T.LongType()) for n in names]
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], *counts]))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def squared_distance() -> Column:
    """Of x0.. to the columns `centre` and `precision` (flat, row by row)."""
    p = len(FEATURES)
    d = [(F.col(f"x{i}") / float(SCALE) - F.col("centre")[i]) for i in range(p)]
    total = F.lit(0.0)
    for i in range(p):
        total = total + F.col("precision")[i * p + i] * d[i] * d[i]
        for j in range(i + 1, p):
            total = total + 2 * F.col("precision")[i * p + j] * d[i] * d[j]
    return total


_PARAMS = "level int, lang string, source string, start int, n long, centre array<double>, precision array<double>, det double"
_KEY = ["level", "lang", "source"]


def _estimates(b: pd.DataFrame, mean: np.ndarray, cov: np.ndarray, raw: np.ndarray) -> pd.DataFrame:
    """Rows of _PARAMS; the determinant is that of the scatter without its floor (its logarithm, NaN-free)."""
    out = b[["level", "lang", "source", "start", "n"]].copy()
    out["centre"], out["precision"] = list(mean), [np.linalg.inv(c).ravel() for c in cov]
    out["det"] = [float(np.linalg.slogdet(r + np.diag(np.square(FLOOR)) / 100)[1]) for r in raw]
    return out


def _medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Quartiles of a group into its first start."""
    for b in batches:
        q = np.array(b["q"].map(lambda rows: [list(r) for r in rows]).tolist(), float).reshape(-1, len(FEATURES), 3) / SCALE
        var = np.array([np.diag(np.maximum((r[:, 2] - r[:, 0]) / 1.349, FLOOR) ** 2) for r in q]).reshape(-1, len(FEATURES), len(FEATURES))
        yield _estimates(b, q[:, :, 1], var, var)


def _moments(scale: float):
    """Sums over rows of a group into its next estimate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(FEATURES)
        for b in batches:
            k = b["k"].to_numpy(float)[:, None]
            mean = np.array([b[f"s{i}"] for i in range(p)], float).reshape(p, -1).T / k
            cov = np.zeros((len(b), p, p))
            for i in range(p):
                for j in range(i, p):
                    cov[:, i, j] = cov[:, j, i] = b[f"s{i}_{j}"].to_numpy(float) / k[:, 0] - mean[:, i] * mean[:, j]
            yield _estimates(b, (mean + OFFSETS) / SCALE, cov * scale / SCALE**2 + np.diag(np.square(FLOOR)), cov / SCALE**2)

    return run


#: Sums are those of the statistics less about their usual values, so that sums of products stay longs for some 10^12 rows.
OFFSETS = (7 * SCALE, 0, 0, 0, 0, 0, 0)


def _sums() -> list[Column]:
    p = len(FEATURES)
    x = [F.col(f"x{i}") - F.lit(OFFSETS[i]) for i in range(p)]
    each = [F.sum(x[i]).alias(f"s{i}") for i in range(p)]
    return each + [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]


def quartiles(leveled: DataFrame) -> DataFrame:
    """Per group n and q, array<array<long>> of the exact quartiles of each statistic, from counts by value."""
    p = len(FEATURES)
    values = leveled.select(*_KEY, F.posexplode(F.array(*(F.col(f"x{i}") for i in range(p)))).alias("i", "x"))
    counts = values.groupBy(*_KEY, "i", "x").agg(F.count("*").alias("c"))
    own = Window.partitionBy(*_KEY, "i")
    upto = counts.withColumns({"n": F.sum("c").over(own), "upto": F.sum("c").over(own.orderBy("x"))})
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("n") * k, F.col("x"))) for k in (1, 2, 3)]
    quart = upto.groupBy(*_KEY, "i").agg(F.first("n").alias("n"), F.array(*at).alias("q"))
    return quart.groupBy(*_KEY).agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda r: r["q"]).alias("q"))


def fit(spark: SparkSession, stats: DataFrame) -> DataFrame:
    """One row a group: level 1 (lang, source), level 2 (lang), and level 0, all rows. stats is read several times: pass a stored table."""
    rows = stats.where(F.col("n_words") >= 10).select("lang", "source", *(f"x{i}" for i in range(len(FEATURES))))
    leveled = rows.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "level", F.when(F.col("level") > 0, F.col("lang")).alias("lang"), F.when(F.col("level") == 1, F.col("source")).alias("source"), *rows.columns[2:]
    )
    starts = quartiles(leveled).withColumn("start", F.lit(0)).mapInPandas(_medians, _PARAMS)
    whole = leveled.groupBy(*_KEY).agg(F.count("*").alias("n"), F.count("*").alias("k"), F.lit(1).alias("start"), *_sums())
    params = materialize(spark, starts.unionByName(whole.mapInPandas(_moments(1.0), _PARAMS)), "mcd")
    for _ in range(STEPS):
        # sums by whole steps of distance, of which the nearest are then taken: one pass over the rows
        near = F.floor(F.log2(1 + measured_distance()) * NEAR).cast("int")
        steps = measured(leveled, params).select(*_KEY, "start", "n", near.alias("near"), *rows.columns[2:])
        summed = steps.groupBy(*_KEY, "start", "near").agg(F.max("n").alias("n"), F.count("*").alias("k"), *_sums())
        before = F.sum("k").over(Window.partitionBy(*_KEY, "start").orderBy("near")) - F.col("k")
        inner = summed.withColumn("before", before).where(F.col("before") < F.ceil(H * F.col("n")))
        total = inner.groupBy(*_KEY, "start").agg(F.max("n").alias("n"), *(F.sum(c).alias(c) for c in summed.columns[5:] if c != "n"))
        stepped = materialize(spark, total.mapInPandas(_moments(CONSISTENCY), _PARAMS), "mcd")
        moved = stepped.select(*_KEY, "start", "centre", "precision").exceptAll(params.select(*_KEY, "start", "centre", "precision")).limit(1).count()
        params = stepped
        if not moved:
            break
    best = params.groupBy(*_KEY).agg(F.min_by(F.struct("n", "centre", "precision", "det", "start"), F.struct("det", "start")).alias("best"))
    return materialize(spark, best.select(*_KEY, "best.*"), "mcd")


def measured_distance() -> Column:
    """squared_distance(), never negative or beyond what the logarithm of a step can hold."""
    return F.least(F.greatest(squared_distance(), F.lit(0.0)), F.lit(1e300))


def measured(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows (level, lang, source, x0..) with start, n, centre and precision of each estimate of their group."""
    own = params.select(*(F.col(c).alias(f"p_{c}") for c in _KEY), "start", "n", "centre", "precision")
    return rows.join(own, on=[rows[c].eqNullSafe(own[f"p_{c}"]) for c in _KEY]).drop("p_level", "p_lang", "p_source")


def judged(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows with base_failed, d2 (null if base_failed) and kept."""
    whole = params.where("level = 0").select(F.col("centre").alias("w_centre"), F.col("precision").alias("w_precision"))
    large = params.where(F.col("n") >= MIN_GROUP)
    own = large.where("level = 1").select(F.col("lang").alias("p_lang"), F.col("source").alias("p_source"), "centre", "precision")
    spoken = large.where("level = 2").select(F.col("lang").alias("l_lang"), F.col("centre").alias("l_centre"), F.col("precision").alias("l_precision"))
    # the estimate of all rows is one row at most
    fallback = whole.take(1)
    w = fallback[0] if fallback else {"w_centre": [0.0] * len(FEATURES), "w_precision": [0.0] * len(FEATURES) ** 2}
    joined = rows.join(own, on=[rows["lang"].eqNullSafe(own["p_lang"]), rows["source"].eqNullSafe(own["p_source"])], how="left").drop("p_lang", "p_source")
    joined = joined.join(spoken, on=joined["lang"].eqNullSafe(spoken["l_lang"]), how="left")
    joined = joined.withColumns({c: F.coalesce(c, f"l_{c}", F.array(*map(F.lit, map(float, w[f"w_{c}"])))) for c in ("centre", "precision")})
    scored = joined.withColumn("base_failed", base_failed()).withColumn("d2", F.when(~F.col("base_failed"), squared_distance())).drop("centre", "precision", "l_lang", "l_centre", "l_precision")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= CUTOFF))


def quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, d2, kept."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", "lang", "source")
    stats = materialize(spark, with_stats(docs, ["doc_id", "lang", "source"]), "quality-stats")
    return judged(stats, fit(spark, stats)).select("doc_id", *_COUNTS, "base_failed", "d2", "kept")


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows, all their columns, that quality() keeps. Texts are read twice and never shuffled but for a large table of groups."""
    stats = materialize(spark, with_stats(docs.select("lang", "source", "text"), ["lang", "source"]), "quality-stats")
    params = fit(spark, stats)
    # numbered names, so that no column of docs is taken for one of the statistics
    own = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own).select(*own, *(F.col(own[docs.columns.index(c)]).alias(c) for c in ("lang", "source", "text")))
    good = judged(with_stats(plain, [*own, "lang", "source"]), params).where("kept")
    return good.select(*own).toDF(*docs.columns)
