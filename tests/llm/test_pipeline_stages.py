"""Each stage of the pipeline against a plain computation of what it keeps, on its predecessor's rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from opsframe.llm import language_id as L
from opsframe.llm import quality_rules as R
from opsframe.llm import queries as Q
from opsframe.llm.common import materialize, table
from tests.llm.test_models_and_layout import brute_classes

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_what_they_should(spark):
    stages = dict(corpus_pipeline.STAGES)
    noise = spark.createDataFrame([(900_000, "1234 !! 99", "en", "s", 10), (900_001, None, "en", "s", 0), (900_002, "ⴰⴱⴲⴳⴴ ⴵⴶⴷⴸⴹ", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars int")
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars")).unionByName(noise)

    told = materialize(spark, stages["language_id"](spark, docs, SF), "told")
    rows = docs.collect()
    languages, scores = L.predict_texts([r.text for r in rows], L.fit(docs))
    assert ids(told) == sorted(r.doc_id for r, lang, score in zip(rows, languages, scores) if lang != "und" and score > 0)
    # the third may be learned from, as its lang is given
    assert not {900_000, 900_001} & set(ids(told))

    good = materialize(spark, stages["quality_rules"](spark, told, SF), "good")
    verdicts = R.quality(spark, told).collect()
    assert ids(good) == sorted(r.doc_id for r in verdicts if r.kept)
    assert all(not r.kept for r in verdicts if r.base_failed) and len(verdicts) > len(ids(good)) > 0

    single = materialize(spark, stages["ngram_jaccard"](spark, good, SF), "single")
    kept = [(r.doc_id, r.text) for r in good.collect()]
    assert ids(single) == sorted({c for c, _ in brute_classes(kept)}) and len(ids(single)) < len(kept)
    texts = {r.doc_id: r.text for r in good.collect()}
    assert all(texts[r.doc_id] == r.text for r in single.collect())

    packed = stages["best_fit_packing"](spark, single, SF).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in single.collect()}
    for doc, size in sizes.items():
        own = sorted((r.piece, r.start, r.length) for r in packed if r.doc_id == doc)
        assert [s for _, s, _ in own] == list(range(0, size, 2048)) and sum(n for *_, n in own) == size
    fill = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * np.ceil(sum(sizes.values()) / 2048) + 1
