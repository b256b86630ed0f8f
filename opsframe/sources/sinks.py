"""Writers: appended check rows, quoted CSV, JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_checks(checks: DataFrame, path: str, optional: tuple[str, ...] = ("details",)) -> None:
    """Append long-format rows, one folder a day. If the write fails, it is tried once more without the optional columns.

    Rows of a write that fails are never seen: Spark moves files in when all tasks are done.
    """
    dated = checks.withColumn("run_date", F.to_date("run_at"))
    write = lambda df: df.write.mode("append").partitionBy("run_date").parquet(path)
    try:
        write(dated)
    except Exception:
        if not set(optional) & set(checks.columns):
            raise
        write(dated.drop(*optional))


def read_checks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several folders; a column that one lacks is null there."""
    parts = [spark.read.parquet(p) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def scan_checks(spark: SparkSession, path: str, as_of: str, hours: int) -> DataFrame:
    """Rows of append_checks from `hours` before as_of on; only the folders of those days are listed and read."""
    start = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    return spark.read.parquet(path).where(F.col("run_date") >= start.cast("date")).where(F.col("run_at") >= start)


def export_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, nulls as empty cells."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").csv(path)


def export_records_json(df: DataFrame, path: str, records: int = 8192) -> None:
    """Files that each hold one JSON array of so many records at most; their number grows with the rows."""
    # row numbers within a partition, so that a block's rows are together before the shuffle
    blocks = df.select(F.expr(f"monotonically_increasing_id() div {records}").alias("block"), F.to_json(F.struct(*df.columns)).alias("record"))
    arrays = blocks.groupBy("block").agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("value"))
    # one array a file: a reader of arrays takes a file as one document
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
