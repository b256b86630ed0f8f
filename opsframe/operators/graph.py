"""Connected components of a similarity graph."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if base is None and not _local:
        _local.append(tempfile.mkdtemp(prefix="opsframe-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return (base or f"file://{_local[0]}").rstrip("/")


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


#: Tasks that one key of a spread join is dealt over, and edges from which joins are spread.
SALTS, SPREAD_FROM = 64, 10_000_000


def spread_join(rows: DataFrame, key: str, by: str, lookup: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows joined with lookup, which has one row a key; rows of one key are dealt over `salts` tasks by another column.

    The lookup's row is sent once for each pair of key and salt that rows have, so rare keys are sent once.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    wanted = salted.select(key, "salt").distinct().join(lookup, key)
    return salted.join(wanted, [key, "salt"]).drop("salt")


def components(spark: SparkSession, edges: DataFrame, spread_from: int = SPREAD_FROM) -> DataFrame:
    """(id, component) for each end of (src, dst): the least id that can be reached.

    Each round gives every vertex the least label of its neighbours and then follows
    labels once (pointer jumping), so long chains take a logarithmic number of rounds.
    A vertex with most of the edges and a component with most of the vertices are keys of these joins;
    in a large graph they are dealt over many tasks.
    """
    both = checkpointed(spark, edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct())
    large = both.count() >= spread_from

    def met(rows: DataFrame, key: str, by: str, lookup: DataFrame) -> DataFrame:
        return spread_join(rows, key, by, lookup) if large else rows.join(lookup, key)

    labels = checkpointed(spark, both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    while True:
        near = met(both, "dst", "src", labels.withColumnRenamed("id", "dst")).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        one = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        two = checkpointed(spark, met(one, "component", "id", jump).select("id", "old", F.least("component", "up").alias("component")))
        labels = two.select("id", "component")
        if two.where("old <> component").limit(1).count() == 0:
            return labels
