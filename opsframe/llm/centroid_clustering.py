"""Clustering around integer centroids, with distances filtered in a rotated space.

One pass gathers the covariance, whose eigenvectors rotate the vectors so that the first
coordinates hold most of what tells them apart. Each vector is stored once, in chunks:
its integers, its leading rotated coordinates dimension by dimension, and the norm of
the rest. A rotation keeps distances, so the distance of the leading coordinates plus
the squared difference of the two residual norms is never more than the squared distance
to a centroid. Every chunk finds each vector's centroid of least bound, takes the
distance to it in integers, and verifies in integers all other centroids whose bound
(less a margin far above the rounding of doubles) does not exceed it. The rotation
decides how many are verified, never which is nearest.

A round sends one row a task and centroid: count and sums, exact integers. Centroids and
their inertias, k rows, are what the driver holds.

Components x become floor(64 x). Defined cases: vectors that are null, hold null or
non-finite components or have another number of components than `dims` take no part; a
null vec_id is clustered like any other, and is the last that may start a centroid;
repeated rows each count, and among rows of one vec_id the smaller vector comes first;
of equally near centroids the smaller number holds; an empty centroid stays; with fewer
than k vectors there are as many centroids as vectors; an empty table gives no rows;
extra columns are ignored. Squared distances have to fit 63 bits: components beyond
2^21 raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import materialize
from opsframe.llm.exact_topk import usable

SCALE = 64
LEADING = 16
CHUNK = 4096

_PACKED = "n int, ids binary, known binary, whole binary, leading binary, residual binary"


def floored(vectors: DataFrame, dims: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): integer vectors of the rows that take part."""
    good = vectors.where(usable("embedding") & (F.size("embedding") == dims))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(scale * c.cast("double"))).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal columns, those of largest variance first; any such matrix gives right results."""
    shape = (dims + 1, dims)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape), 0
        for batch in batches:
            x = matrix(batch.column(0), dims).astype(np.float64)
            n += len(x)
            total += np.vstack((x.T @ x, x.sum(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), n))], ["slot", "value"])

    sums = vectors.select("x").mapInArrow(gather, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).orderBy("slot").toPandas()["value"].to_numpy()
    if not len(sums) or sums[-1] == 0:
        return np.eye(dims)
    total, n = sums[:-1].reshape(shape), sums[-1]
    values, axes = np.linalg.eigh(total[:dims] / n - np.outer(total[dims], total[dims]) / n**2)
    return axes[:, ::-1]


def pack(vectors: DataFrame, axes: np.ndarray, leading: int) -> DataFrame:
    """Chunks of vectors with their leading rotated coordinates and residual norms."""
    dims = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x, ids = matrix(part.column(1), dims), part.column(0)
                if np.abs(x).max(initial=0) >= 1 << 27:
                    raise ValueError("components beyond 2^21 have squared distances that don't fit a long")
                lead, rest = rotate(x, axes, leading)
                row = (len(x), ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), x.astype(np.int32).tobytes(), lead.tobytes(), rest.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), *[pa.binary()] * 5))], ["n", "ids", "known", "whole", "leading", "residual"])

    return vectors.select("vec_id", "x").mapInArrow(run, _PACKED)


def rotate(x: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """leading x n coordinates and n norms of the rest."""
    turned = x @ axes
    return np.ascontiguousarray(turned[:, :leading].T), np.sqrt((turned[:, leading:] ** 2).sum(1))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid and the squared distance to it, exact."""
    c_lead, c_rest = rotate(centroids, axes, len(lead))
    squares = (lead**2).sum(0) + rest**2
    bound = np.stack([((lead - c_lead[:, [j]]) ** 2).sum(0) + (rest - c_rest[j]) ** 2 for j in range(len(centroids))])
    bound -= 1e-9 * (squares + (c_lead**2).sum(0)[:, None] + c_rest[:, None] ** 2 + 1)
    x = x.astype(np.int64)
    first = bound.argmin(0)
    reach = ((x - centroids[first]) ** 2).sum(1)
    best, own = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for j, c in enumerate(centroids):
        at = np.flatnonzero(bound[j] <= reach)
        d = ((x[at] - c) ** 2).sum(1)
        nearer = d < best[at]
        best[at[nearer]], own[at[nearer]] = d[nearer], j
    return own, best


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, axes: np.ndarray, leading: int) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            x = np.frombuffer(row["whole"], np.int32).reshape(row["n"], len(axes))
            lead, rest = np.frombuffer(row["leading"]).reshape(leading, row["n"]), np.frombuffer(row["residual"])
            yield row, x, *nearest(x, lead, rest, centroids, axes)


def cluster_sums(stored: DataFrame, centroids: np.ndarray, axes: np.ndarray, leading: int) -> dict[int, tuple[int, int, list[int]]]:
    """Count, summed distance and componentwise sums of each centroid's vectors."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, distance, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x, own, best in _assigned(batches, centroids, axes, leading):
            np.add.at(count, own, 1)
            np.add.at(distance, own, best)
            np.add.at(sums, own, x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.array(distance), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "count", "distance", "sums"])

    parts = stored.mapInArrow(run, "cluster int, count long, distance long, sums array<long>")
    total: list[Column] = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
    rows = parts.groupBy("cluster").agg(F.sum("count").alias("count"), F.sum("distance").alias("distance"), *total).where("count > 0").collect()
    return {r["cluster"]: (r["count"], r["distance"], [r[f"s{i}"] for i in range(dims)]) for r in rows}


def first_centroids(vectors: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors of smallest sha256 of seed and id."""
    drawn = vectors.withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = drawn.orderBy(F.asc_nulls_last("draw"), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, dims)


def cluster(spark: SparkSession, vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1, leading: int = LEADING) -> DataFrame:
    """(vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>)."""
    leading = min(leading, dims)
    whole = floored(vectors, dims)
    axes = rotation(whole, dims)
    stored = materialize(spark, pack(whole, axes, leading), "rotated")
    centroids = first_centroids(whole, k, seed, dims)
    for _ in range(rounds):
        for j, (count, _, sums) in cluster_sums(stored, centroids, axes, leading).items():
            centroids[j] = [s // count for s in sums]
    inertia = {j: distance for j, (_, distance, _) in cluster_sums(stored, centroids, axes, leading).items()} if len(centroids) else {}
    own_inertia = np.array([inertia.get(j, 0) for j in range(len(centroids))], np.int64)
    total = sum(inertia.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, own, best in _assigned(batches, centroids, axes, leading):
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], np.bool_))
            where = pa.DictionaryArray.from_arrays(pa.array(own), pa.array([c.tolist() for c in centroids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(own), pa.array(best), pa.array(own_inertia[own]), pa.array(np.full(len(own), total, np.int64)), where.dictionary_decode()],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"],
            )

    return stored.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")


def centroid_digest(centroid: str = "centroid") -> Column:
    return F.sha2(F.array_join(F.transform(centroid, lambda c: c.cast("string")), ","), 256)


def centroid_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
