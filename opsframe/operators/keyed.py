"""Per-key picks, upserts, slices and distributed ranks."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.operators.graph import checkpointed


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of least `order` for each key; order has to be unique in a key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k of each key, with their rank; Spark keeps k rows a task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows of updates overwrite `cols`, with nulls too, or are added; updates has one row a key."""
    new = fresh("new", target, updates)
    joined = target.join(updates.select(*keys, F.struct(*cols).alias(new)), keys, "full_outer")
    return joined.select(*(F.when(F.col(new).isNotNull(), F.col(new)[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns))


def patch(target: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Only non-empty fields of updates change the target."""
    new = fresh("new", target, updates)
    joined = target.join(updates.select(key, F.struct(*cols).alias(new)), key, "left")
    return joined.select(*(F.coalesce(F.nullif(F.col(new)[c], F.lit("")), F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns))


def delete_ids(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


#: Keys that a range of the order is cut at in one round, and rows that are few enough to sort at once.
SPLITTERS, FEW = 31, 20_000


def paginate(df: DataFrame, page: int, size: int, order: list[str]) -> DataFrame:
    """One page, clamped to the last, with total and total_pages."""
    total = df.count()
    pages = max(1, -(-total // size))
    at = min(max(1, page), pages)
    rows = range_select(df, order, (at - 1) * size + 1, at * size).drop("position")
    return rows.withColumns({"total": F.lit(total).cast("long"), "total_pages": F.lit(pages).cast("long")})


def _below(key: list[Column], at: tuple) -> Column:
    """Whether the key comes before `at`, nulls first."""
    out = F.lit(False)
    for k, v in reversed(list(zip(key, at))):
        out = k.isNull() & out if v is None else k.isNull() | F.coalesce(k < F.lit(v), F.lit(False)) | (k.eqNullSafe(F.lit(v)) & out)
    return out


def _equal(key: list[Column], at: tuple) -> Column:
    return reduce(Column.__and__, (k.eqNullSafe(F.lit(v)) for k, v in zip(key, at)))


def _slot(key: list[Column], cuts: list[tuple], first: int = 0) -> Column:
    """How many of the sorted cuts are at or before the key: a binary search written as nested conditions."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(_below(key, cuts[mid]), _slot(key, cuts[:mid], first)).otherwise(_slot(key, cuts[mid + 1 :], first + mid + 1))


@dataclass(frozen=True)
class Start:
    """Where a range of an order begins: at a key or behind it, with so many rows before, and `heavy` rows of that key if they are many."""

    key: tuple | None = None
    behind: bool = False
    before: int = 0
    heavy: int = 0

    def reached(self, key: list[Column]) -> Column:
        if self.key is None:
            return F.lit(True)
        at = ~_below(key, self.key)
        return at & ~_equal(key, self.key) if self.behind else at


def order_statistic(df: DataFrame, order: list[str], position: int, few: int = FEW) -> Start:
    """A start that has at most `few` rows between it and the row at `position` (from 1), or whose key is that row's.

    A histogram refined by descent: keys drawn at random cut the range that holds the
    position, one aggregate counts the parts, and the part that holds it is the next
    range. Nothing is written, and the driver sees some cuts and counts a round; the
    rounds grow with the logarithm of the rows.
    """
    key, draw = [F.col(c) for c in order], fresh("draw", df)
    start, high, size = Start(), None, df.count()
    while size > few:
        inside = df.where(start.reached(key) if high is None else start.reached(key) & _below(key, high))
        drawn = inside.select(*order, F.rand(17).alias(draw)).orderBy(draw).limit(SPLITTERS).drop(draw).collect()
        cuts = sorted({tuple(r) for r in drawn}, key=lambda r: [(v is not None, v) if v is not None else (False,) for v in r])
        if cuts == [start.key]:  # one key has most of the range, if not all
            equal = inside.where(_equal(key, start.key)).count()
            if position <= start.before + equal:
                return Start(start.key, False, start.before, equal)
            start, size = Start(start.key, True, start.before + equal), size - equal
            continue
        counts = dict(inside.groupBy(_slot(key, cuts).alias("slot")).count().collect())
        slot, before = 0, start.before
        while slot < len(cuts) and before + counts.get(slot, 0) < position:
            before += counts.get(slot, 0)
            slot += 1
        start = Start(cuts[slot - 1], False, before) if slot else start
        high, size = cuts[slot] if slot < len(cuts) else high, counts.get(slot, 0)
    return start


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """All rows with their position in the order: range partitions are numbered within, and the counts of those before (one row each) are added."""
    part, at = fresh("part", df), fresh("at", df)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, as the bounds are sampled anew each time that the plan runs
    ranged = checkpointed(df.sparkSession, df.repartitionByRange(partitions, *order).withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(part).agg(F.count("*").alias("n"))
    shift = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(at))
    within = ranged.withColumn("position", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return within.join(shift, part).withColumn("position", (F.col("position") + F.col(at)).cast("long")).drop(part, at)


def range_select(df: DataFrame, order: list[str], lo: int, hi: int, few: int = FEW) -> DataFrame:
    """Rows lo..hi (from 1; hi 0: no upper bound) of the order, nulls first, with their position.

    A bounded range is found by order statistics: what is sorted is a top-k of the rows
    from a start shortly before it. Rows of equal keys stand in any order among
    themselves. Without an upper bound, or beyond `few` rows, all rows are ranked.
    """
    if not hi or hi - lo >= few:
        placed = ranked(df, order)
        return placed.where((F.col("position") >= lo) & (F.col("position") <= hi if hi else F.lit(True)))
    key = [F.col(c) for c in order]
    start = order_statistic(df, order, lo, few)
    first, before = df.where(start.reached(key)), start.before
    if start.heavy:
        skipped = lo - before - 1
        equal = df.where(_equal(key, start.key)).limit(min(start.heavy - skipped, hi - lo + 1))
        first = equal.unionByName(df.where(replace(start, behind=True).reached(key)).orderBy(*order).limit(max(0, hi - before - start.heavy)))
        before += skipped
    numbered = first.orderBy(*order).limit(hi - before).withColumn("position", (F.row_number().over(Window.orderBy(*order)) + before).cast("long"))
    return numbered.where(F.col("position") >= lo)


def union_dedup(dfs: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """The first of each key, earlier sources first."""
    source = fresh("source", *dfs)
    tagged = [d.withColumn(source, F.lit(i)) for i, d in enumerate(dfs)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return first_per_key(out, [key], [source, *order]).drop(source)


def latest_rows(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("run_at"), "seq").limit(n)


def window_scan(df: DataFrame, as_of: str, hours: int) -> DataFrame:
    return df.where(F.col("run_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
