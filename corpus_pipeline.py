"""A training corpus out of documents: language ID, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; run() stores each stage's rows as Parquet in the shared folder and rereads
them. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsframe.llm import best_fit_packing, language_id, ngram_join, quality_rules
from opsframe.llm.common import materialize, table
from opsframe.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told stay."""
    return language_id.keep_identified(spark, docs, language_id.fit(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay that pass the base limits and are no outlier of their language and source."""
    return quality_rules.keep_good(spark, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays."""
    return ngram_join.keep_first(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows packed into sequences: one row a piece."""
    return best_fit_packing.pack(spark, docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage), ("ngram_jaccard", near_duplicate_stage), ("best_fit_packing", packing_stage)]

#: Trained models and robust estimates are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
