"""Sharding by jump consistent hashing.

The shard of a row depends on its key and the number of shards alone: a mixed key
seeds a generator whose jumps name the shard counts at which the key moves, and the
last jump below the count is its shard. There is no ring table. With one more shard,
1 / (n + 1) of the keys move, all of them into the new shard.

Slots number the rows of a shard without gaps. Each task numbers its own rows per
shard, in the order of its partition; the rows are stored once, and the counts of
the tasks before it (one row a task and shard) are added. No shard is ever sorted
or gathered, and equal keys cost nothing extra.

Defined cases: null text has 0 bytes and CRC 0; a null key is one key of its own;
repeated rows share a shard and have slots of their own; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.llm.common import materialize


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, after Lamping and Veach."""
    state = keys.astype(np.uint64).copy()
    out = np.zeros(len(state), np.int64)
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        out[live] = at[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (state[live] >> np.uint64(33)).astype(np.float64) + 1
        at[live] = ((at[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        live = live[at[live] < shards]
    return out


def assign_shards(spark: SparkSession, rows: DataFrame, shards: int) -> DataFrame:
    """rows (key long, more columns) with shard, grown_shard (one shard more) and slot."""
    if {"shard", "grown_shard", "slot", "part"} & {c.lower() for c in rows.columns}:
        raise ValueError("shard, grown_shard, slot and part are names of the result")
    names = [*rows.columns, "part", "shard", "grown_shard", "slot"]
    # the two columns behind those of the caller, whatever their names are
    source = rows.select("*", F.xxhash64("key", F.lit("shard")), F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shards, np.int64)
        for batch in batches:
            h = batch.column(batch.num_columns - 2).to_numpy().view(np.uint64)
            shard = jump_hash(h, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            slot = local + seen[shard]
            seen += counts
            columns = [*batch.columns[:-2], batch.column(batch.num_columns - 1), pa.array(shard.astype(np.int32)), pa.array(jump_hash(h, shards + 1).astype(np.int32)), pa.array(slot)]
            yield pa.RecordBatch.from_arrays(columns, names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = materialize(spark, source.mapInArrow(run, f"{ddl}, part int, shard int, grown_shard int, slot long"), "shards")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return placed.join(offsets, ["shard", "part"]).withColumn("slot", F.col("slot") + F.col("first")).drop("part", "first")


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("key"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(spark, rows, shards)
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

