"""Memories bounded by bytes, names of the caller, and whole tables against plain computation."""

from __future__ import annotations

import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opsframe.llm import best_fit_packing as B
from opsframe.llm import exact_topk as K
from opsframe.llm import jump_sharding as J
from opsframe.llm import license_scan as L
from opsframe.llm import piece_lattice as P
from opsframe.llm import quality_rules as R
from opsframe.llm import queries as Q
from opsframe.llm import token_counts as N
from opsframe.llm.common import Memory, sliced, table

SF = "/root/testdata/sf0.01"


def size_of(memory: dict) -> int:
    return sys.getsizeof(memory) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in memory.items())


def lines(n: int, length: int):
    """Distinct lines without blanks."""
    for i in range(n):
        part = f"{i:x}漢字é" if i % 2 else f"a{i:x}b-"
        yield (part * (length // len(part) + 1))[:length]


def test_memory_holds_no_more_than_it_may():
    memory = Memory(1 << 20)
    for i in range(100_000):
        assert memory.keep(f"word{i}é漢", b"x" * (i % 50), i % 50) == b"x" * (i % 50)
    assert 0 < size_of(memory) < 2 << 20
    assert memory.keep("k" * 65, 7) == 7 and "k" * 65 not in memory


@pytest.mark.parametrize("length", [60, 2000])
def test_memories_of_texts_without_blanks(length):
    """50,000 distinct lines: what workers keep stays under its bytes, and long lines are not kept."""
    words, counter = B.WordIds(Q.tokenizer_path("word_bpe_49k.json")), N.ChunkCounter(N.PieceModel(Q.tokenizer_path("piece_bpe_32k.model")))
    n = 50_000 if length == 2000 else 5_000
    kept = lambda: size_of(words) + size_of(words.words)
    for i, line in enumerate(lines(n, length)):
        if i % 50 == 0 or length == 60:  # the models are slow on these; the memories see every fiftieth long line whole
            words[line], counter.bare[line]
        else:
            words.keep(line, b"")
    assert kept() < B.MEMO_BYTES + B.WORD_MEMO_BYTES + (64 << 20)
    memories = (counter.bare, counter.spaced, counter.bare.known)
    assert all(size_of(m) < N.MEMO_BYTES + (32 << 20) for m in memories)
    assert all(len(k) <= 64 for m in (words, words.words, *memories) for k in m)
    assert (length == 60) == (len(words) > 0)


def test_small_memories_change_no_result(monkeypatch):
    texts = ["the and of thing " * 50 + f"x{i} " * 20 + "y" * 200 for i in range(40)]
    path, model = Q.tokenizer_path("word_bpe_49k.json"), Q.tokenizer_path("piece_bpe_32k.model")
    want = [B.WordIds(path).of(t) for t in texts], [N.ChunkCounter(N.PieceModel(model)).inner(" " + t) for t in texts]
    for module, name in ((B, "MEMO_BYTES"), (B, "WORD_MEMO_BYTES"), (N, "MEMO")):
        monkeypatch.setattr(module, name, 20 if name == "MEMO" else 2000)
    words, counter = B.WordIds(path), N.ChunkCounter(N.PieceModel(model))
    assert ([words.of(t) for t in texts], [counter.inner(" " + t) for t in texts]) == want


def test_a_word_of_its_own_is_remembered_once():
    words = B.WordIds(Q.tokenizer_path("word_bpe_49k.json"))
    text = "Thing thing, straße don't thing 漢字 x1 'sfoo &&'s"
    assert words.of(text) == np.array(words.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    # "thing" stands alone and before a comma
    assert "thing" in words and "straße" in words and "straße" not in words.words
    words.clear()
    words.words.clear()
    words["alone"]
    assert "alone" in words and not words.words


def test_texts_are_taken_a_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000))], ["x"])
    parts = list(sliced([batch, batch.slice(0, 0), batch]))
    assert max(p.num_rows for p in parts) <= 1024 and [x for p in parts for x in p.column(0).to_pylist()] == [*range(5000)] * 2


def test_counted_words_are_sent_on_by_characters(spark, monkeypatch):
    pieces = P.Pieces(Q.tokenizer_path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(i, "ab cd " * 30 + "漢" * i) for i in range(60)], "doc_id long, text string")
    want = {r.word: r.n for r in P.distinct_fragments(docs, pieces).collect()}
    monkeypatch.setattr(P, "COUNTED_CHARS", 300)
    assert {r.word: r.n for r in P.distinct_fragments(docs, pieces).collect()} == want


def test_token_counts_of_all_documents(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    want = {(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in table(spark, SF, "documents").collect()}
    got = Q.op4_token_counts(spark, SF).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want and len(got) == 1000
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_base_phrases_of_all_documents(spark):
    got = {r.doc_id: r for r in Q.op2_license_fuzzy(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
        places = [(i, label) for phrase, label in L.BASE.items() for parts in [phrase.split()] for i in range(len(words)) if words[i : i + len(parts)] == parts]
        own = got[r.doc_id]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        assert (own.n_words, own.n_base, own.first_word, own.last_word, own.base_labels) == (len(words), len(places), first, last, ",".join(sorted({p[1] for p in places})))
        assert set(filter(None, own.base_labels.split(","))) <= set(own.labels.split(",")) and own.n_spans == len(own.spans)


def test_every_notice_is_found_with_edits(spark):
    """A notice with as many edits as its length allows, inside a whole text; and not with many more."""
    rows, want = [], {}
    for i, (label, phrase) in enumerate(L.NOTICES):
        k = len(phrase) // L.EDITS_PER
        broken = "".join(c for j, c in enumerate(phrase) if not (c == " " or j % 9 != 4) or j // 9 >= k or c == " " or j % 9 != 4)
        rows += [(i, f"Some words before. {broken.upper()}! And 20 words after."), (1000 + i, " ".join(w[::-1] + "q" for w in phrase.split()))]
        want[i] = label
    got = {r.doc_id: r for r in L.scan_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in want.items():
        span = next(s for s in got[i].spans if s.label == label)
        assert label in got[i].labels.split(",") and span.first_word == 3 and span.last_word >= span.first_word
        assert got[1000 + i].labels == ""


def test_shards_with_names_of_the_caller(spark):
    rows = spark.range(200).select(F.col("id").alias("key"), F.lit("own").alias("__hash"), F.lit(1.5).alias("hash"))
    got = J.assign_shards(spark, rows, 7).collect()
    assert {r["__hash"] for r in got} == {"own"} and {r["hash"] for r in got} == {1.5}
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    with pytest.raises(ValueError):
        J.assign_shards(spark, rows.withColumn("Slot", F.lit(1)), 7)


def test_sums_are_those_of_offsets(spark):
    """Means and scatters come back from sums of small numbers."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9000, (50, len(R.FEATURES)))
    df = spark.createDataFrame([(0, "a", "b", 0, *map(int, r)) for r in x], "level int, lang string, source string, start int, " + ", ".join(f"x{i} long" for i in range(x.shape[1])))
    summed = df.groupBy("level", "lang", "source", "start").agg(F.count("*").alias("n"), F.count("*").alias("k"), *R._sums())
    row = summed.mapInPandas(R._moments(1.0), R._PARAMS).head()
    assert np.abs(np.array(row.centre) - x.mean(0) / R.SCALE).max() < 1e-12
    scatter = np.linalg.inv(np.array(row.precision).reshape(len(row.centre), -1)) - np.diag(np.square(R.FLOOR))
    assert np.abs(scatter - np.cov(x.T, bias=True) / R.SCALE**2).max() < 1e-6 * np.abs(scatter).max()


def test_cells_copy_little():
    for cells in (8, 12, 200, 10_000):
        for queries, vectors in ((2, 100), (1, 1), (0, 0), (100, 1), (2_000_000, 100_000_000)):
            rows, columns = K.grid(cells, queries, vectors)
            assert rows * columns >= cells and queries * columns + vectors * rows <= 2.1 * max(vectors, min(queries * c + vectors * -(-cells // c) for c in range(1, cells + 1)))


def test_edges_of_short_words_are_not_sorted(spark):
    pieces = P.Pieces(Q.tokenizer_path("piece_bpe_32k.model"))
    table = pieces.table()
    words = [" the", " tionheheble", "漢字 🙂"[:2], "🙂", "\n", " antidisestabli", " " * 16, "é"]
    df = spark.createDataFrame(list(enumerate(words)), "key long, word string")
    found = P.short_lattice(df.repartition("key"), spark.createDataFrame(table), pieces.longest)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # sums of fixed size, that are merged in place: no lists, which are sorted on disk beyond 128 words
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan and "SortMergeJoin" not in plan
    rows = table.to_pylist()
    known = {r["piece"] for r in rows}
    tops = {r.word: r.tops for r in found.collect()}
    assert set(tops) == set(words)
    for word in words:
        ends = [[n for n in range(e, 0, -1) if n == 1 or word[e - n : e] in known] for e in range(1, len(word) + 1)]
        assert [63 - (t >> 28) for t in tops[word]] == [n[0] for n in ends]
        inner = [rows[k]["inner"] if (k := t & (1 << 22) - 1) < P.NO_PIECE else [t] for t in tops[word]]
        assert [[63 - (x >> 28 & 63) for x in own] for own in inner] == ends


def test_ids_lie_on_disk_once(spark, monkeypatch):
    pieces = P.Pieces(Q.tokenizer_path("piece_bpe_32k.model"))
    stored, write = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda s, df, label: (stored.append(label), write(s, df, label))[1])
    texts = spark.createDataFrame([(i, f"tionheheble{i} the") for i in range(50)], "doc_id long, text string")
    found = P.encode_texts(spark, texts, pieces, 10)
    rows = found.collect()
    assert len(rows) == 50 and all(r.round_trip for r in rows)
    # the texts' ids are only shuffled, and in one shuffle for both their uses
    assert stored == ["words", "word-ids"]
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_words_are_cut_many_at_once():
    pieces = P.Pieces(Q.tokenizer_path("piece_bpe_32k.model"))
    words = [" the", "\n", " a漢字b", " \ud800x", " 🙂", " co-op(s)", " ", "  x"]
    found, sizes = pieces.fragments_of(words)
    assert found == [f for w in words for f in pieces.fragments(w)] and sizes.tolist() == [len(pieces.fragments(w)) for w in words]
    assert pieces.fragments_of([])[0] == []


def test_texts_are_cut_many_at_once():
    pieces = P.Pieces(Q.tokenizer_path("piece_bpe_32k.model"))
    random.seed(4)
    texts = [None, "", " ", "  ", "\n", "a\nb", "a \n b", "\n\n", " a", "a ", "a  b c", "漢字 🙂é", "d▁e", "▁"]
    texts += ["".join(random.choices(["ab", "the", " ", "  ", "\n", "é", "漢", "🙂", "0", "▁"], k=random.randint(0, 30))) for _ in range(300)]
    fragments, sizes, n_words = pieces.cut(pa.array(["not this", *texts, "nor this"])[1:-1])
    want, at = fragments.to_pylist(), 0
    for text, size, n in zip(texts, sizes, n_words):
        text = (text or "").replace("▁", " ")
        words = re.findall(r"\n[^ \n]*| +[^ \n]*", " " + text) if text else []
        assert want[at : at + size] == [f for w in words for f in pieces.fragments(w)] and n == len(words)
        at += size
    assert at == len(want)


def test_blocks_of_texts_are_bounded(monkeypatch):
    monkeypatch.setattr(P, "TEXTS", 4)
    monkeypatch.setattr(P, "BLOCK_BYTES", 10)
    texts = ["abc", None, "", "abcdefg", "x" * 50, "", "a", "a", "a", "a", "a"]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    blocks = [b.column(0).to_pylist() for b in P._blocks(iter([batch, batch.slice(0, 0), batch]), 0)]
    assert [t for b in blocks for t in b] == texts * 2
    assert all(len(b) <= 4 and (len(b) == 1 or sum(len(t or "") for t in b) <= 10) for b in blocks)


def test_texts_are_shuffled_small_and_other_fragments_once_a_block(spark, monkeypatch):
    pieces = P.Pieces(Q.tokenizer_path("piece_bpe_32k.model"))
    seen, missing = [], P._missing
    monkeypatch.setattr(P, "_missing", lambda parts: (seen.append(parts), missing(parts))[1])
    texts = spark.createDataFrame([(i, "tionheheble andthontionwh the") for i in range(200)], "doc_id long, text string").repartition(2)
    rows = P.encode_texts(spark, texts, pieces, 0).collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows)
    # 600 words, of three kinds, in two tasks
    assert missing(seen[0]).count() <= 6
    seen.clear()
    docs = table(spark, SF, "documents")
    n = P.encode_texts(spark, docs, pieces).agg(F.sum("n_pieces")).head()[0]
    binary = [f.name for f in seen[0].schema if f.dataType.simpleString() == "binary"]
    # a byte a piece, where compressed ids of each text take more
    assert seen[0].agg(sum(F.sum(F.octet_length(c)) for c in binary)).head()[0] < n
