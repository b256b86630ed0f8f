"""Language ID, quality rules, packing, lattice, shards, n-gram join, pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import best_fit_packing as B
from opsframe.llm import jump_sharding as J
from opsframe.llm import language_id as L
from opsframe.llm import ngram_join as G
from opsframe.llm import piece_lattice as P
from opsframe.llm import quality_rules as R
from opsframe.llm import queries as Q
from opsframe.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, "/root/testdata/sf0.01", "documents")


def test_language_accuracy_and_cases(spark, docs):
    model = L.fit(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in L.predict(spark, docs, model).collect()}
    held = [i for i in truth if L.is_held_out(i)]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.98
    assert L.predict_texts([None, "", "12 !", "é" * 3 + " zzzqqq"], model)[0][:3] == ["und"] * 3
    long = "the and of ing tion " * 120_000  # more than one slab
    lang, score = L.predict_texts([long, long[:20_000]], model)
    assert lang[0] == lang[1] and abs(score[0] - score[1]) < 1e-3
    none = L.fit(docs.where("lang is null"))
    assert L.predict_texts(["abc"], none) == (["und"], [0.0])
    assert L.pick_below(5_000_000_000, 4000) / L.PICKS == pytest.approx(4000 / 5e9) and L.pick_below(10, 4000) == L.PICKS
    odd = docs.selectExpr("doc_id", "if(doc_id % 50 = 0, null, text) as text", "lang", "source", "1 as score")
    unknown = spark.createDataFrame([(1, "ⴰⴱⴲⴳⴴ ⴵⴶⴷⴸⴹ", "en", "s"), (2, "12", "en", "s")], "doc_id long, text string, lang string, source string")
    assert L.keep_identified(spark, unknown, model).count() == 0
    assert [r.doc_id for r in L.keep_identified(spark, unknown, none).collect()] == [1]
    empty = docs.limit(0)
    assert L.fit(empty).languages == [] and L.predict(spark, empty, model).count() == 0 and L.keep_identified(spark, empty, model).count() == 0
    kept = L.keep_identified(spark, odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.where("text is not null").count()


def test_language_as_plain_sets_of_ngrams(spark, docs):
    """The same prediction from a plain dictionary of n-grams to languages, where the filters' false positives do not decide."""
    model = L.fit(docs, 300, 2000)
    rows = [r for r in docs.collect() if r.text and r.lang and not L.is_held_out(r.doc_id)]

    def grams(text):
        folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\0" for c in f"\0{text}\0")
        return [w for i in range(len(folded) - 3) if "\0\0" not in (w := folded[i : i + 4])]

    count = {lang: {} for lang in model.languages}
    picked = spark.createDataFrame([(r.lang, r.text) for r in rows], "lang string, text string").distinct()
    sizes = {lang: sum(r.lang == lang for r in rows) for lang in model.languages}
    for r in picked.withColumn("pick", F.pmod(F.xxhash64("text"), F.lit(L.PICKS))).collect():
        if r.pick < L.pick_below(sizes[r.lang], 300):
            for w in grams(r.text):
                count[r.lang][w] = count[r.lang].get(w, 0) + 1
    known = {lang: set(sorted(c, key=lambda w: -c[w])[:2000]) for lang, c in count.items()}
    got = {r.doc_id: r.lang_pred for r in L.predict(spark, docs, model).collect()}
    same = []
    for r in docs.where('length(text) < 3000').limit(300).collect():
        hits = {lang: sum(w in known[lang] for w in grams(r.text or "")) for lang in known}
        first, second = sorted(hits.values())[-1:-3:-1]
        if first > 1.1 * second + 5:
            same.append(got[r.doc_id] == max(hits, key=hits.get))
    assert len(same) > 200 and all(same)
    twice = docs.limit(20).union(docs.limit(20))
    assert L.predict(spark, twice, model).count() == 40


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)]


def test_quality_counts(docs):
    texts = [r.text for r in docs.limit(150).collect()] + [None, "", "a b\na b\n \n \n", "x y z w v " * 40, " a b c", "a\rb\rc"]
    for t in texts:
        assert R.text_stats(t)[0] == base_counts(t)


def test_quality_verdicts(spark, docs):
    got = {r.doc_id: r for r in R.quality(spark, docs).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    good = [i for i, q in labels.items() if q == 1 and not got[i].base_failed]
    bad = [i for i, q in labels.items() if q == 0]
    assert np.mean([got[i].kept for i in good]) > 0.98
    assert np.mean([got[i].kept for i in bad]) < 0.4
    clash = docs.selectExpr("*", "1 as n_words", "2 as x0", "3 as kept", "'a' as c1")
    kept = R.keep_good(spark, clash)
    assert kept.columns == clash.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.kept}
    few = spark.createDataFrame([(1, None, None, None), (2, "a " * 3, "en", None), (None, "w%d " % 5 * 30, None, "s")], "doc_id long, text string, lang string, source string")
    assert R.quality(spark, few).where("not kept").count() == 3
    assert R.quality(spark, few.limit(0)).count() == 0


def test_quality_cutoff_rejects_broken_texts(spark):
    x = R.CUTOFF
    beyond = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3 + x * x / 15)
    assert abs(beyond - 1e-4) < 1e-8
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = R.quality(spark, docs).join(labels, "doc_id").join(docs.select("doc_id", F.contains("text", F.lit(" | ")).alias("broken")), "doc_id").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert np.mean([r.kept for r in bad]) < 0.02
    assert np.mean([r.kept for r in bad if r.broken]) < 0.05
    assert np.mean([r.kept for r in good]) > 0.995


def test_robust_estimate_ignores_a_contaminated_share(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (900, 7)), rng.normal(30, 1, (100, 7))]) * R.SCALE
    rows = [("en", "s", 20, *map(int, r)) for r in x]
    df = spark.createDataFrame(rows, "lang string, source string, n_words long, " + ", ".join(f"x{i} long" for i in range(7)))
    own = R.fit(spark, df).where("level = 1").first()
    assert np.abs(own.centre).max() < 0.3
    far = ((np.array([30.0] * 7) - own.centre) @ np.array(own.precision).reshape(7, 7)) @ (np.array([30.0] * 7) - own.centre)
    assert far > R.CUTOFF


def test_estimate_as_plain_c_steps(spark):
    """The estimate of one group, from numpy C-steps over the same steps of distance from both starts."""
    rng = np.random.default_rng(11)
    p = len(R.FEATURES)
    x = np.round(np.vstack([rng.normal(0, 1, (600, p)) @ rng.normal(0, 0.5, (p, p)), rng.normal(4, 0.3, (150, p))]) * R.SCALE)
    df = spark.createDataFrame([("en", "s", 20, *map(int, r)) for r in x], "lang string, source string, n_words long, " + ", ".join(f"x{i} long" for i in range(p)))
    ends = []
    q = np.array([[np.sort(c)[int(np.ceil(len(c) * k / 4)) - 1] for k in (1, 2, 3)] for c in x.T]) / R.SCALE
    floor = np.diag(np.square(R.FLOOR))
    for centre, cov in ((q[:, 1], np.diag(np.maximum((q[:, 2] - q[:, 0]) / 1.349, R.FLOOR) ** 2)), (x.mean(0) / R.SCALE, np.cov(x.T, bias=True) / R.SCALE**2 + floor)):
        for _ in range(R.STEPS):
            d = x / R.SCALE - centre
            d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
            near = np.floor(np.log2(1 + d2) * R.NEAR)
            cut = np.sort(near)[int(np.ceil(R.H * len(x))) - 1]
            own = x[near <= cut] / R.SCALE
            raw = np.cov(own.T, bias=True)
            centre, cov = own.mean(0), raw * R.CONSISTENCY + floor
        ends.append((np.linalg.slogdet(raw + floor / 100)[1], centre, np.linalg.inv(cov)))
    det, centre, precision = min(ends, key=lambda e: e[0])
    own = R.fit(spark, df).where("level = 1").first()
    assert np.allclose(own.centre, centre, atol=2e-3) and np.allclose(np.array(own.precision).reshape(p, p), precision, rtol=0.02, atol=0.02 * np.abs(precision).max())
    dealt = R.fit(spark, df.repartition(7)).where("level = 1").first()
    assert dealt == own


def test_repeats_are_compared_word_by_word(monkeypatch):
    words = [b"a", b"b", b"c", b"d", b"e", b"f"] * 2
    plain = R.repeated_words(words)
    monkeypatch.setattr(R, "hash", lambda w: 1, raising=False)
    assert R.repeated_words(words) == plain == 12 and R.repeated_words([bytes([i]) for i in range(60, 90)]) == 0


def test_small_group_uses_its_language(spark):
    rng = np.random.default_rng(3)
    row = lambda lang, source, at: (lang, source, 20, 0, *map(int, (rng.normal(0, 1, 7) + at) * R.SCALE))
    rows = [row("en", "s", 0) for _ in range(1000)] + [row("fr", f"s{k % 4}", 40) for k in range(200)] + [row("en", "few", 40)]
    df = spark.createDataFrame(rows, "lang string, source string, n_words long, n_repeat_words long, " + ", ".join(f"x{i} long" for i in range(7)))
    got = R.judged(df, R.fit(spark, df)).groupBy("lang", "source").agg(F.mean(F.col("kept").cast("int")).alias("share")).collect()
    share = {(r.lang, r.source): r.share for r in got}
    assert share["en", "s"] > 0.9 and share["en", "few"] == 0
    assert all(share["fr", f"s{k}"] > 0.9 for k in range(4))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [r.text for r in docs.limit(120).collect()] + [None, "", "<|endoftext|> It's", "ΑΣ Σ", "é İ", "a\x1cb c", "word " * 5000]
    df = spark.createDataFrame([(i % 50, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, uid int").repartition(4)
    rows = B.pack(spark, df, path, 256, 64).collect()
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i % 50, k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    partial = [r.length for r in rows if r.length < 256]
    assert len(bins) <= len(rows) - len(partial) + len(B.best_fit(partial, 256)) + 1
    assert B.pack(spark, df.limit(0), path).count() == 0


def fewest_bins(lengths, capacity):
    """By trying all partitions, longest first."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_packing_beside_the_fewest_bins():
    random.seed(5)
    over = []
    for _ in range(60):
        lengths = [random.randint(5, 60) for _ in range(9)]
        over.append(len(B.improve(B.best_fit(lengths, 100), lengths, 100)) - fewest_bins(lengths, 100))
    # the search is no exact packer: one bin more in 5 of the 60 cases
    assert set(over) == {0, 1} and sum(over) <= 5


def test_sequences_of_full_pieces_differ_at_any_size():
    ids = {B.full_sequence(part, n) for part in (0, 1, 32_767, 32_768, 65_536, 800_000, (1 << 22) - 1) for n in (0, 1, 32_768, (1 << 40) - 1)}
    assert len(ids) == 28 and all(0 < i < 1 << 63 and i % 2 for i in ids)


def test_local_search_empties_bins():
    random.seed(2)
    for _ in range(20):
        lengths = [random.randint(1, 100) for _ in range(150)]
        before = B.best_fit(lengths, 100)
        after = B.improve(before, lengths, 100)
        assert sorted(i for b in after for i in b) == list(range(150)) and len(after) <= len(before)
        assert all(sum(lengths[i] for i in b) <= 100 for b in after)
    assert len(B.improve([[0, 1], [2], [3]], [40, 30, 55, 45], 100)) <= 2


def test_shards(spark, docs):
    df = docs.selectExpr("if(doc_id % 90 = 0, null, doc_id) as doc_id", "if(doc_id % 7 = 0, null, text) as text", "'x' as shard", "1 as slot").union(docs.limit(5).selectExpr("doc_id", "text", "'y'", "2")).repartition(6)
    rows = J.shard_documents(spark, df, 40).collect()
    assert len(rows) == df.count()
    by, key = {}, {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert key.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(40))
    texts = sorted((t or "") for (t,) in df.select("text").collect())
    assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32(t.encode()) for t in texts)
    assert sum(r.size for r in rows) == sum(len(t.encode()) + 16 for t in texts)
    assert J.shard_documents(spark, df.limit(0)).count() == 0


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_as_published():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 2000, dtype=np.uint64)
    for n in (1, 2, 40, 41, 1000):
        assert J.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def best_score(word, rows, longest):
    score = {p: s for p, _, s in rows}
    best = [0.0]
    for end in range(1, len(word) + 1):
        best.append(max(best[a] + score[word[a:end]] for a in range(max(0, end - longest), end) if word[a:end] in score))
    return best[-1]


@pytest.fixture(scope="module")
def sentencepieces():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = Q.tokenizer_path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = 1
    return path, sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_unigram_lattice_as_the_library(spark, sentencepieces):
    path, _, library = sentencepieces
    pieces = P.Pieces(path, "unigram")
    known = P.known_fragments(spark, table(spark, SF, "documents").limit(40), pieces).collect()
    # ranks as scores are beyond what the library's single precision tells apart in whole texts, so fragment by fragment, by score
    words = [r for r in known if re.fullmatch(" [^ \n]+", r.word) and not any(3 <= i < 259 for i in r.ids)]
    score = {i: s for _, i, s in pieces.rows}
    total = lambda ids: sum(score[i] for i in ids)
    assert len(words) > 500
    for r in words:
        theirs = library.encode(r.word[1:])
        assert total(r.ids) == best_score(r.word, pieces.rows, pieces.longest)
        assert r.ids == theirs or total(r.ids) >= total(theirs)
    assert np.mean([r.ids == library.encode(r.word[1:]) for r in words]) > 0.99


def test_texts_come_back_from_their_ids(spark, sentencepieces):
    path, library, _ = sentencepieces
    texts = [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    texts += [None, "", " ", "  a  b\n\nc \n 漢🙂", "x" * 100 + "the" * 40, "\n", "d▁e", "▁", "twice", "twice", "\n\n a", "a\n", " \n b", "ab" * 9000, "tokenisation of antidisestablishment"]
    random.seed(8)
    for _ in range(150):
        texts.append(" ".join("".join(random.choices(["ab", "the", "ing", "x", "é", "漢字", "aaa", "0", "!", "er", "ter", "\n", "  "], k=random.randint(1, 40))) for _ in range(3)))
    df = spark.createDataFrame([(i // 2 if i % 7 else None, i, t, "w") for i, t in enumerate(texts)], "doc_id long, i int, text string, word string").repartition(3)
    ids = [library.encode(t or "") for t in texts]
    back = [library.decode(x) for x in ids]
    want = sorted((str(i // 2 if i % 7 else None), len(x), tuple(x), b, b == (t or "")) for i, (t, x, b) in enumerate(zip(texts, ids, back)))
    for most in (P.FREQUENT, 60, 0):  # all, some and no fragments known to all tasks
        rows = P.encode_texts(spark, df, P.Pieces(path), most).collect()
        assert sorted((str(r.doc_id), r.n_pieces, tuple(r.ids), r.decoded, r.round_trip) for r in rows) == want
    assert [t for t, b in zip(texts, back) if b != (t or "")] == ["d▁e", "▁"]
    assert set(Q.op8_piece_lattice(spark, SF).columns) == {"doc_id", "n_words", "n_pieces", "ids", "decoded", "round_trip"}
    assert P.encode_texts(spark, df.limit(0), P.Pieces(path)).count() == 0


def test_no_row_of_the_lattice_carries_the_piece_table(spark, sentencepieces):
    words = spark.createDataFrame([(1, "the")], "key long, word string")
    plan = P.encode_words(spark, words, P.Pieces(sentencepieces[0]))._jdf.queryExecution().optimizedPlan().toString()
    assert "array(scalar-subquery" in plan[: plan.index("Join")] and "[] AS facts" not in plan


def test_frequent_fragments_keep_both_bounds(spark):
    known = spark.createDataFrame([(f"w{i}", max(1, 1000 - i), [i]) for i in range(500)], "word string, n long, ids array<int>")
    for most, most_bytes in ((500, 1 << 20), (100, 1 << 20), (500, 900), (0, 0)):
        got = {r.word for r in P.frequent(known, most, most_bytes).collect()}
        assert len(got) <= most and sum(len(w) + 4 for w in got) <= most_bytes
        assert got == {f"w{i}" for i in range(len(got))}
    assert P.frequent(known.limit(0)).count() == 0


def brute_classes(rows):
    """(least doc_id of the component, links) per row number, from sets of word windows."""
    sets = []
    for _, t in rows:
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("text", t or "")})
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(least.get(find(i)), links[i]) for i in range(len(rows))]


def test_ngram_join(spark, docs):
    random.seed(6)
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    base = " ".join(f"w{i}" for i in range(300)).split()
    for i in range(330):  # a group of near copies larger than one block
        w = list(base)
        w[random.randrange(300)] = f"v{i}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000, None), (20_001, ""), (20_002, "!!"), (20_003, "!!"), (20_004, "one two"), (20_005, "One, two!"), (None, "one two"), rows[0], rows[0]]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, node string").repartition(4)
    want = sorted(((d, c, n) for (d, _), (c, n) in zip(rows, brute_classes(rows))), key=str)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in G.ngram_join(spark, df).collect()), key=str)
    assert got == want
    kept = G.keep_first(spark, df)
    assert kept.columns == df.columns and kept.count() == len({c for _, c, _ in want})
    nobody = spark.createDataFrame([(None, " ".join(base) + f" v{i % 40}") for i in range(400)] + [(None, "one two")] * 50, "doc_id long, text string")
    assert [tuple(r) for r in G.ngram_join(spark, nobody).groupBy("class_id", "n_links").count().orderBy("count").collect()] == [(None, 49, 50), (None, 399, 400)]
    assert G.keep_first(spark, nobody).count() == 2
    assert G.ngram_join(spark, df.limit(0)).count() == 0 and G.keep_first(spark, df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF)
        assert after.columns == docs.columns and 0 < after.count() <= left.count(), name
        left = after
    odd = docs.selectExpr("if(doc_id % 9 = 0, null, doc_id) as doc_id", "if(doc_id % 40 = 0, null, text) as text", "lang", "source", "n_chars", "1 as c0", "'x' as kept").union(docs.limit(3).selectExpr("doc_id", "text", "lang", "source", "n_chars", "2", "'y'"))
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, rows, SF)
            assert after.columns == odd.columns and after.count() <= rows.count() and after.where("text is null").count() == 0, name
            rows = after
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in left.select("doc_id").collect()}
