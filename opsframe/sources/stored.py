"""Stored tables that change by key: buckets of Parquet files, rewritten where touched, and a manifest that is swapped last.

A table is a folder. `data/<write>/<bucket>` holds files, `versions/<n>.json` names the
folder of each bucket. A change reads and rewrites the buckets that its keys fall in,
and takes effect when its manifest appears; until then, and if the write fails, readers
have the version before. Files of untouched buckets stay where they are. One writer
changes a table at a time: a second one that began from the same version is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opsframe.operators import keyed


class StoredTable:
    """A table at `path` of rows with unique keys."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, keys: list[str], buckets: int) -> StoredTable:
        """A new table; the number of buckets is that of the files that a change can leave alone."""
        table = cls(spark, path)
        first = {"version": -1, "keys": keys, "buckets": buckets, "schema": rows.schema.json(), "files": {}, "batches": {}}
        table._publish(first, table._write(rows, first))
        return table

    def manifest(self) -> dict:
        names = [n for n in self._names("versions") if n.endswith(".json")]
        if not names:
            raise FileNotFoundError(f"no table at {self.path}")
        stream = self._fs.open(self._at("versions", names[-1]))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest version, or some buckets of it."""
        return self._rows(self.manifest(), buckets)

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.path}/{p}" for b, p in state["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int")

    def _write(self, rows: DataFrame, state: dict) -> dict[str, str]:
        write, number = uuid.uuid4().hex, keyed.fresh("bucket", rows)
        rows.withColumn(number, self._bucket(state)).repartition(number).write.partitionBy(number).parquet(f"{self.path}/data/{write}")
        return {n.split("=")[1]: f"data/{write}/{n}" for n in self._names("data", write) if n.startswith(f"{number}=")}

    def _publish(self, before: dict, files: dict[str, str], batches: dict | None = None) -> None:
        after = before | {"version": before["version"] + 1, "files": files, "batches": before["batches"] | (batches or {})}
        final, draft = self._at("versions", f"{after['version']:012d}.json"), self._at("versions", f".{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {after['version']} of {self.path} was written by another")

    def change(self, by: DataFrame, how: Callable[[DataFrame], DataFrame], batches: dict | None = None) -> list[int]:
        """Rewrite the buckets that the keys of `by` fall in; gives their numbers, of which there are no more than buckets."""
        state = self.manifest()
        number = keyed.fresh("bucket", by)
        touched = sorted(r[0] for r in by.select(self._bucket(state).alias(number)).distinct().collect())
        kept = {b: p for b, p in state["files"].items() if int(b) not in touched}
        new = self._write(how(self._rows(state, touched)), state) if touched else {}
        self._publish(state, kept | new, batches)
        return touched

    def upsert(self, updates: DataFrame, columns: list[str], batches: dict | None = None) -> list[int]:
        """Rows of updates (one a key) overwrite `columns`, with nulls too, or are added."""
        keys = self.manifest()["keys"]
        return self.change(updates, lambda old: keyed.merge_upsert(old, updates, keys, columns), batches)

    def patch(self, updates: DataFrame, columns: list[str]) -> list[int]:
        """Only non-empty fields of updates change rows that are there."""
        (key,) = self.manifest()["keys"]
        return self.change(updates, lambda old: keyed.patch(old, updates, key, columns))

    def delete(self, keys: DataFrame) -> list[int]:
        names = self.manifest()["keys"]
        return self.change(keys, lambda old: old.join(keys.select(*names), names, "left_anti"))

    def upsert_batch(self, name: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: each batch of the stream `name` is merged once, also if it is sent again after a failure."""

        def merge(batch: DataFrame, number: int) -> None:
            if self.manifest()["batches"].get(name, -1) < number:
                batch.persist()
                try:
                    self.upsert(batch, columns, {name: number})
                finally:
                    batch.unpersist()

        return merge
