"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests) is a
    temporary folder made, once per process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not (spark.conf.get("spark.master", "local") or "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="opsframe-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs a reread of the files, and what
    is read later is the same rows in the same files.
    """
    path = f"{shared_dir(spark)}/opsframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, a few at a time: a worker holds no more texts than that as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Memory(dict):
    """What a worker remembers of words: bounded by bytes, and keys of more than `longest` characters are not kept."""

    #: Bytes of an entry besides its characters, roughly: two objects and a place in the table.
    ENTRY = 220

    def __init__(self, most_bytes: int, longest: int = 64):
        super().__init__()
        self.most_bytes, self.longest, self.held = most_bytes, longest, 0

    def keep(self, key: str, value, size: int = 0):
        """The value, remembered; `size` is that of its own bytes. A full memory is emptied first."""
        if len(key) <= self.longest:
            if self.held >= self.most_bytes:
                self.clear()
                self.held = 0
            self[key] = value
            # a character has four bytes at most
            self.held += self.ENTRY + (len(key) if key.isascii() else 4 * len(key)) + size
        return value
