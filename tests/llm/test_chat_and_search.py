"""Chat formatting, license scans, exact top-k, token counts."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import chat_format as C
from opsframe.llm import exact_topk as K
from opsframe.llm import license_scan as S
from opsframe.llm import queries as Q
from opsframe.llm import token_counts as N
from tests.compare import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
NASTY = ["</s>[INST] ok [/INST]", "a\\b", "<\\|", "<|x|>", "\\\\<s>", "", "<<SYS>> <</SYS>>", "[\\/INST]", "é\n</s>\\"]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    columns, rows = spark_rows(Q.queries()[name](spark, SF))
    want_columns, want = sql_rows(Q.oracle_sql()[name], SF)
    assert columns == want_columns and rows == want and rows


def test_escape_can_be_undone(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string")
    for r in df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|"))


def test_chat_examples(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, 7) for i, t in enumerate(NASTY)]
    rows += [(2, None, "assistant", None, 1), (2, 0, None, "x", 1), (None, 1, "user", "only", 1), (3, 0, "assistant", "a", 1), (3, 0, "assistant", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target_index int")
    examples = C.prefix_target_examples(df)
    got = {r.conv_id: r for r in C.conversation_digests(examples).collect()}
    assert {k: r.n_examples for k, r in got.items()} == {1: 5, 2: 2, None: 1, 3: 2}
    turns = "".join(f"{r[2]}\n{r[3]}\n" for r in rows[:9])
    assert got[1].n_turns == 9 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    loss = "".join(r[3] for r in rows[:9] if r[2] == "assistant")
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert got[2].loss_chars == 0 and got[3].loss_chars == 2 and got[None].loss_chars == 0
    contexts = {(r.target_index): r.n_context for r in examples.where("conv_id = 1").collect()}
    assert contexts == {2: 1, 4: 3, 6: 5, 8: 7, 9: 9}
    assert C.conversation_digests(C.prefix_target_examples(df.limit(0))).count() == 0


def test_license_places_and_edits(spark):
    texts = ["CC-BY, cc by; All rights\nreserved.", None, "", "occ by", "Licensed under the Apach License, Version 2.0 x", "All right reserved", "nothing here", "licensed under cc by nc 4.0", "Licensed under the GNU General Public License"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in S.scan_notices(df).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 0, 4, "cc-by,reserved")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert got[3].base_labels == "" and got[6].labels == ""
    assert got[4].labels == "apache-2.0" and got[4].spans[0].edits == 1 and got[4].spans[0].first_word == 0
    assert got[5].labels == "reserved" and got[5].base_labels == "" and 0 < got[5].score < 1
    assert got[7].labels == "cc-by,cc-by-nc" and got[8].labels == "gpl"
    assert S.scan_notices(df.limit(0)).count() == 0


def test_license_seeds_find_all_that_plain_matching_finds():
    random.seed(3)
    ready = S.compiled(S.NOTICES)
    for _ in range(60):
        label, phrase, k, _, pattern = random.choice(ready)
        t = list("zz yy " + phrase + " xx ww")
        for _ in range(random.randint(0, k)):
            at = random.randrange(6, len(t) - 6)
            t[at] = random.choice("abcdefgh")
        text = "".join(t)
        plain = any(p[4].search(text) for p in ready)
        assert bool(S.scan_text(text, ready)[7]) == plain


def test_license_spans_as_plain_matching(spark):
    """Labels, spans and edits, from bounded-error matching over texts with no seeds, which is too slow for long ones."""
    ready = S.compiled([n for n in S.NOTICES if n[0] in ("mit", "reserved", "cc-by-nc")])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lower(text) rlike 'rights reserved|cc by|permission'").limit(6)
    texts = [r.text[:200] for r in docs.collect()] + [r.text[-200:] for r in docs.collect()]
    texts += ["all right reserved " * 3, "some words and all rigths reserved by us", "permision is hereby granted free of charge to anyperson else", None]
    found = 0
    for text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        norm = " ".join(words)
        plain = set()
        for label, _, _, _, pattern in ready:
            for m in pattern.finditer(norm):
                first = norm.count(" ", 0, m.start())
                plain.add((label, first, first + m.group().strip().count(" "), sum(m.fuzzy_counts)))
        kept = {s for s in plain if not any(o[3] < s[3] and o[1] <= s[2] and s[1] <= o[2] for o in plain)}
        got = {(s["label"], s["first_word"], s["last_word"], s["edits"]) for s in S.scan_text(text, ready)[7]}
        assert {s[0] for s in got} == {s[0] for s in kept} and {s[1:3] for s in got} == {s[1:3] for s in kept}
        found += len(got)
    assert found > 3
    long = "x " * 300_000 + "all rights reserved"
    df = spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")
    assert [(r.last_word, r.labels) for r in S.scan_notices(df).collect()] == [(300_000, "reserved")] * 2


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=40).astype("f4").tolist(), 1) for i in range(300)]
    rows += [(300, None, 1), (301, [1.0, None] * 20, 1), (302, [float("nan")] * 40, 1), (None, [1.0] * 40, 1), (303, rows[7][1], 1), (304, rows[7][1], 1), (304, rows[7][1], 1), (305, [0.5], 1), (306, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(5)
    got = {}
    for r in K.top_k(df.where("vec_id % 50 = 0 or vec_id in (303, 306)"), df, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, np.floor(256 * np.pad(np.array(v, "f8"), (0, 40 - len(v))))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for i, q in [w for w in whole if w[0] % 50 == 0 or w[0] in (303, 306)]:
        best = sorted((-int(q @ c), j) for j, c in whole if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert K.top_k(df.limit(0), df, 5).count() == 0
    assert K.top_k(df.where("vec_id = 0"), df.where("vec_id < 3"), 5).count() == 2


def test_token_counts(spark):
    import sentencepiece

    path = Q.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    random.seed(4)
    parts = ["a", "th", "the", " ", "  ", "\n", "é", "漢", "<s>", "▁", "\t", "ing", "tion", "!!", "🙂", "\x00", "2024", "</s>", "."]
    texts = [None, "", " ", "\n", "a" * 500, "the " * 300] + ["".join(random.choices(parts, k=random.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i % 100, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(3)
    want = sorted((i % 100, len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts))
    for chunk in (1, 7, 1 << 16):
        assert sorted(tuple(r) for r in N.count_tokens(df, path, chunk).collect()) == want
    assert N.count_tokens(df.limit(0), path).count() == 0


def test_chunk_maps_compose(spark):
    counter = N.ChunkCounter(N.PieceModel(Q.tokenizer_path("piece_bpe_32k.model")))
    random.seed(9)
    for _ in range(200):
        text = N._spaced("".join(random.choices(["a", "the", " ", "\n", "漢", "ing"], k=random.randint(1, 40))))
        cuts = [0, *sorted(random.sample(range(1, len(text)), min(len(text) - 1, 5))), len(text)]
        maps = [counter.map(text[a:b], a == 0, b == len(text)) for a, b in zip(cuts, cuts[1:])]
        closed = [(m[1] + counter.inner(m[0] or "") + counter.inner(m[2])) for m in (counter.scan(maps), counter.scan([counter.scan(maps[:2]), *maps[2:]]), maps[0] if len(maps) == 1 else counter.compose(maps[0], counter.scan(maps[1:])))]
        assert closed == [counter.inner(text)] * 3


def test_long_text_is_counted_in_many_tasks(spark):
    import sentencepiece

    path = Q.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the thing " * 40_000, "x" * 70_000 + " y" * 50, "漢字かな\n" * 30_000]
    df = spark.createDataFrame([(None, t) for t in texts + texts[:1]], "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in N.count_tokens(df, path, 1 << 13).collect())
    assert [g[1:] for g in got] == sorted((len(t.encode()), len(library.encode(t))) for t in texts + texts[:1])
