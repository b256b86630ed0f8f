"""Files and sitemaps hold a bounded number of records, whatever the table's size."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from opsframe.plans import catalog_queries
from opsframe.sources import readers, sinks


def test_json_arrays_are_bounded(spark, tmp_path):
    df = spark.range(40_000).selectExpr("cast(id as string) as id", "if(id % 3 = 0, null, 'a \"b\"') as name").repartition(3)
    path = f"{tmp_path}/json"
    sinks.export_records_json(df, path)
    sizes = [len(json.loads(r.value)) for r in spark.read.option("wholetext", True).text(path).collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 8192
    back = readers.read_records_json(spark, path, "id string, name string")
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_sitemaps_grow_in_number(spark):
    entries = F.size(F.regexp_extract_all("text", F.lit("<url>"), 0)).alias("n")
    small, large = ([r.n for r in catalog_queries._xml(spark, f"/root/testdata/{sf}").select(entries).collect()] for sf in ("sf0.01", "sf0.1"))
    assert sum(large) == 10 * sum(small) and max(large) <= 500
    assert len(large) > 5 * len(small)
