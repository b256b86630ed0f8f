"""Exact top-k by inner product: columnar branch-and-bound.

Candidates and queries are packed into chunks kept dimension by dimension (one
contiguous row a dimension). The grid of query chunks and candidate chunks is an
equi-join on the numbers of both chunk groups, so each cell is one row and no
vector pair is ever a row. Within a cell, scores grow block of dimensions by
block; after each block a candidate stays only if its score so far plus the
product of the remaining norms (Cauchy-Schwarz) can still reach the query's
current k-th best score, and the survivors are compacted before the next block.
A task emits at most k rows per query of each cell; a grouped aggregation keeps
the best k of those.

Components x become floor(256 x). Defined cases: vectors that are null or hold
null or non-finite components take no part; vectors of unequal length are padded
with zeros; ties go to the smaller vec_id; rows that repeat a vec_id each count,
and every row of a query's own id is left out for it; null ids take no part; with
fewer than k candidates all are returned; an empty table gives no rows; extra
columns are ignored. Scores have to fit 53 bits, as they are summed in doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024
QUERY_CHUNK = 512
BLOCK = 16

_PACKED = "group long, n int, dims int, ids binary, columns binary"
_HITS = "query_id long, vec_id long, score long"


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def pack(vectors: DataFrame, size: int) -> DataFrame:
    """(id, v array<double>) into chunks of at most `size`, floored, vertical."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
            flat = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            lengths = np.diff(lists.offsets.to_numpy())
            dims = int(lengths.max(initial=0))
            full = np.zeros((len(ids), dims))
            full[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            rows = []
            for at in range(0, len(ids), size):
                own, columns = ids[at : at + size], np.ascontiguousarray(full[at : at + size].T)
                narrow = columns.astype(np.int32) if np.abs(columns).max(initial=0) < 1 << 31 else columns
                rows.append((number, len(own), dims, own.tobytes(), narrow.tobytes()))
                number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                ["group", "n", "dims", "ids", "columns"],
            )

    return vectors.mapInArrow(packed, _PACKED)


def unpack(columns: bytes, dims: int, n: int) -> np.ndarray:
    """dims x n doubles of what pack has stored as 32-bit integers, or as doubles where those are too narrow."""
    kind = np.int32 if len(columns) == 4 * dims * n else np.float64
    return np.frombuffer(columns, kind).reshape(dims, n).astype(np.float64)


def search_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Best k of the candidates c (dims x n) for each query of q (dims x m)."""
    dims = max(len(q), len(c))
    q, c = (np.pad(x, ((0, dims - len(x)), (0, 0))) for x in (q, c))
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], np.ascontiguousarray(c[:, order])
    cuts = [*range(0, dims, BLOCK), dims]
    mass_q, mass_c = (np.array([np.sqrt((x[a:] ** 2).sum(0)) for a in cuts]) for x in (q, c))
    # a first threshold for each query: exact scores of a few candidates of large norm
    probe = np.argsort(-mass_c[0], kind="stable")[: 4 * k + 1]
    known = q.T @ c[:, probe]
    out = []
    for j, own in enumerate(q_ids):
        alive = np.flatnonzero(c_ids != own)
        tried = np.sort(known[j][c_ids[probe] != own])
        least = tried[-k] if len(tried) >= k else -np.inf
        score = np.zeros(len(alive))
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            block = c[lo:hi] if len(alive) == c.shape[1] else c[lo:hi, alive]
            score = score + q[lo:hi, j] @ block
            if hi == dims:
                break
            rest = mass_q[b + 1, j] * mass_c[b + 1, alive]
            if len(score) > k:
                floor = score - rest
                least = max(least, np.partition(floor, len(floor) - k)[len(floor) - k])
            keep = score + rest >= least - 1
            if not keep.all():
                alive, score = alive[keep], score[keep]
        best = np.lexsort((c_ids[alive], -score))[:k]
        out += [(int(own), int(c_ids[alive[i]]), int(score[i])) for i in best]
    return out


def grid(cells: int, queries: int, vectors: int) -> tuple[int, int]:
    """Rows and columns of cells that copy the fewest vectors."""
    cells_q = min(cells, max(1, round(math.sqrt(cells * queries / max(1, vectors)))))
    return cells_q, -(-cells // cells_q)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """queries, vectors: (vec_id, embedding). Returns query_id, rank, vec_id, score."""
    clean = lambda df: df.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    # as many cells as shuffle partitions at least; each side is copied once a row or column of cells, which is least where these are as the sides' sizes
    cells = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells_q, cells_c = grid(cells, queries.count(), vectors.count())
    number = lambda n: F.pmod(F.xxhash64("group", "ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = pack(clean(vectors), CHUNK).withColumn("cell_c", number(cells_c)).withColumn("cell_q", every(cells_q))
    left = pack(clean(queries), QUERY_CHUNK).withColumn("cell_q", number(cells_q)).withColumn("cell_c", every(cells_c))
    right = right.select("cell_q", "cell_c", F.col("n").alias("c_n"), F.col("dims").alias("c_dims"), F.col("ids").alias("c_ids"), F.col("columns").alias("c_columns"))
    cells = left.select("cell_q", "cell_c", "n", "dims", "ids", "columns").join(right, ["cell_q", "cell_c"]).drop("cell_q", "cell_c")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, c = (unpack(row[p + "columns"], row[p + "dims"], row[p + "n"]) for p in ("", "c_"))
                hits = search_cell(np.frombuffer(row["ids"], np.int64), q, np.frombuffer(row["c_ids"], np.int64), c, k)
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    hits = cells.mapInArrow(search, _HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
