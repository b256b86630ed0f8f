"""Whitening, centroid clustering and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from opsframe.llm import centroid_clustering as C
from opsframe.llm import queries as Q
from opsframe.llm import suffix_dedup as S
from opsframe.llm import whitening as W
from tests.compare import rows_of

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def cut_by_hand(rows, width=50):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by a dictionary of all 50-byte strings."""
    texts, first = [(d, (t or "").encode()) for d, t in rows], {}
    for d, t in texts:
        for i in range(len(t) - width + 1 if d is not None else 0):
            first[t[i : i + width]] = min(d, first.get(t[i : i + width], d))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1 if d is not None else 0):
            if first[t[i : i + width]] < d:
                gone[i : i + width] = [True] * width
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def cut(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, block int, spans string")
    return S.removal_digests(S.remove_repeats(spark, df)).collect()


def same(got, want):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return rows_of(names, [tuple(r) for r in got]) == rows_of(names, want)


def test_cover_meets_every_difference():
    """For any two residues there is a step within the period that takes both into the cover."""
    for a in range(S.PERIOD):
        for b in range(S.PERIOD):
            assert any((a + i) % S.PERIOD in S.COVER and (b + i) % S.PERIOD in S.COVER for i in range(S.PERIOD))


@pytest.mark.parametrize("seed", range(4))
def test_removal_is_exact(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdefgh é", "中文x", "\x00\n a"][seed]
    pool = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 120))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(-60, 60) if rng.random() < 0.9 else None, "".join(parts) if rng.random() < 0.95 else None))
    rows += [(7, "a" * 300), (9, "a" * 70), (9, "a" * 49), (3, "a" * 50), (3, "a" * 50), (None, "a" * 80), (70, ""), (71, None)]
    got = cut(spark, rows)
    assert same(got, cut_by_hand(rows))
    assert sum(r.n_removed for r in got) > 1000


def test_long_texts_cross_units(spark, monkeypatch):
    """Texts longer than the bytes that are worked on at a time, cut in every step."""
    monkeypatch.setattr(S, "UNIT", 700)
    monkeypatch.setattr(S, "RANGE", 5000)
    monkeypatch.setattr(S, "TUPLE_RANGE", 3000)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    base = " ".join(rng.choice(words) for _ in range(1500))
    rows = [(i, base[rng.randrange(3000) : 3000 + rng.randrange(5000)] if i % 3 else " ".join(rng.choice(words) for _ in range(800))) for i in range(30)]
    # functions that run in workers read the module's values where they are
    blocks = [S.Block({"ids": np.array([i for i, _ in rows], np.int64).tobytes(), "known": b"\x01" * 30, "lengths": np.array([len(t) for _, t in rows], np.int64).tobytes(), "text": S.zstandard.compress("".join(t for _, t in rows).encode())})]
    places = {(u.a + int(p)) for u in blocks[0].units() for p in u.samples(40)[0]}
    ends = blocks[0].ends
    for at in range(0, int(ends[-1]) - 50, 37):
        if int(ends[np.searchsorted(ends, at, "right")]) - at >= 50:
            assert len(places & set(range(at, at + S.PERIOD))) == len(S.COVER)
    assert same(cut(spark, rows), cut_by_hand(rows))


def test_colliding_keys_are_told_apart(monkeypatch):
    """Where unequal prefixes share a mixed key, the bytes decide."""
    monkeypatch.setattr(S, "mixed", lambda *parts: np.zeros(len(parts[0]), np.uint64))
    rng = np.random.default_rng(3)
    pool = rng.integers(97, 99, (9, 50)).astype(np.uint8)
    picks, docs = rng.integers(0, 9, 200), rng.integers(0, 1000, 200)
    least = S.least_documents(pool[picks].ravel(), np.arange(200) * 50, docs)
    alike = (pool[picks][:, None] == pool[picks][None]).all(2)
    assert (least == [docs[a].min() for a in alike]).all()


def test_hot_copies_and_empty_table(spark):
    page = " ".join(f"word{i % 17}x{i}" for i in range(60))
    rows = [(i, page if i % 3 else page[: 100 + i] + f" own end {i} " + page[200:]) for i in range(600)]
    got = cut(spark, rows)
    assert same(got, cut_by_hand(rows))
    assert cut(spark, []) == []
    spans = S.remove_repeats(spark, spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()
    for r, (_, text) in zip(sorted(spans, key=lambda r: r.doc_id), rows):
        left, at = b"", 0
        for s in r.spans:
            left, at = left + text.encode()[at : s.start], s.end
        assert left + text.encode()[at:] == bytes(r.kept)


def test_removal_over_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert same(Q.op13_suffix_dedup(spark, SF).collect(), cut_by_hand(rows))


def test_blocks_do_not_move(spark):
    """Later joins meet the stored blocks where they are."""
    df = S.remove_repeats(spark, spark.createDataFrame([(1, "a" * 60)], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    text_side = plan[plan.index("blocks_") - 400 : plan.index("blocks_")]
    assert "Bucketed: true" in plan and "Exchange" not in text_side
    assert df.count() == 1 and not [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def whiten_by_hand(x, k):
    fits = np.unique(x, axis=0)
    n, mean = len(fits), fits.mean(0)
    centred = fits - mean
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, fits.sum(0))) for row in x]
    return n, deviation, (x - mean) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_whitening(rows, ids, x, k):
    n, deviation, white, explained = whiten_by_hand(x, k)
    for c in range(k):
        got = [r for r in rows if r.component == c + 1]
        by_id = {r.vec_id: r for r in got}
        assert len(got) == len(ids) and {r.n for r in got} == {n}
        assert [by_id[i].deviation for i in ids] == deviation
        values = np.array([by_id[i].whitened for i in ids])
        assert min(np.abs(values - white[:, c]).max(), np.abs(values + white[:, c]).max()) < 1e-9 * np.abs(white).max()
        assert abs(got[0].explained / explained[c] - 1) < 1e-10 and got[0].identity_error < 1e-10


def test_whitening_over_embeddings(spark):
    kept = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([[int(np.floor(256 * float(c))) for c in r.embedding] for r in kept])
    check_whitening(Q.op11_whitening(spark, SF).collect(), [r.vec_id for r in kept], x, 4)


def test_whitening_cases(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((60, 6)) * [5, 4, 3, 2, 1, 1]).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(i + 100, v) for i, v in enumerate(vectors[:20])]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [NAN] * 6), (203, [INF] * 6)]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, whitened double, n string")
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v in rows])
    check_whitening(W.whiten(spark, df).collect(), [i for i, _ in rows], x, 4)
    short = [(0, [1.0, 2.0]), (1, [4.0]), (2, []), (None, [0.5, -2.0]), (2, [])]
    got = W.whiten(spark, spark.createDataFrame(short, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 and {r.component for r in got} == {1, 2} and {r.n for r in got} == {4}
    assert sum(r.vec_id is None for r in got) == 2
    for equal in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)], [(1, [])]):
        assert W.whiten(spark, spark.createDataFrame(equal, "vec_id long, embedding array<double>")).collect() == []
    line = W.whiten(spark, spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_deviation_beyond_a_long():
    x = np.array([[1 << 20, 0], [0, 0]], np.int64)
    n, sums = 1 << 12, np.array([0, 1], object)
    assert W.deviations(x, n, sums) == [None, 1] and W.deviations(x >> 10, n, sums) == [(1 << 44) + 1, 1]


@pytest.mark.parametrize("kind", ["random", "close", "repeated", "low rank", "small"])
def test_jacobi_davidson(kind):
    rng = np.random.default_rng(2)
    d = {"small": 3}.get(kind, 90)
    spectrum = {"close": 1 + 1e-6 * np.arange(d), "repeated": np.repeat([5.0, 2.0, 1.0], d // 3), "low rank": np.r_[[3.0, 2.0], np.zeros(d - 2)]}.get(kind, rng.random(d))
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = W.jacobi_davidson(lambda b: a @ b, d, 4)
    k = min(4, d)
    assert np.abs(values - np.sort(spectrum)[::-1][:k]).max() < 1e-13 * max(spectrum) * d
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-12 * max(spectrum)


def test_minres_on_an_indefinite_operator():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a, b = a + a.T, rng.standard_normal((30, 3))
    assert np.abs(a @ W.minres(lambda y: a @ y, b, 60, 1e-13) - b).max() < 1e-8
    steps = [np.linalg.norm(a @ W.minres(lambda y: a @ y, b, s, 0) - b) for s in (1, 3, 9, 20)]
    assert steps == sorted(steps, reverse=True)


def cluster_by_hand(rows, k, rounds, dims):
    x = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(x, key=lambda r: ((r[0] is None), hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in x]
        groups = {j: [v for (_, v), o in zip(x, own) if o == j] for j in set(own)}
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else old for j, old in enumerate(centroids)]
    last = [near(v) for _, v in x]
    total = {j: sum(d for d, o in last if o == j) for _, j in last}
    return [(i, j, d, total[j], sum(total.values()), C.centroid_sha256(centroids[j])) for (i, _), (d, j) in zip(x, last)]


def test_clustering_cases(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), (rng.standard_normal(5) * 3).round(1).tolist()) for i in rng.integers(0, 90, 200)]
    rows += [(None, [1.0] * 5), (300, None), (301, [NAN] * 5), (302, [1.0] * 4), (303, [1.0, None, 1.0, 1.0, 1.0]), (304, []), (305, [-0.0] * 5)] + [(306, [2.0] * 5)] * 40
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

    def got(data, k=6, leading=2):
        df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, cluster int, x string")
        found = C.cluster(spark, df, k, 3, 5, leading=leading)
        return rows_of(names, [tuple(r) for r in found.withColumn("centroid_sha256", C.centroid_digest()).select(names).collect()])

    want = rows_of(names, cluster_by_hand(rows, 6, 3, 5))
    assert got(rows) == want == got(rows, leading=5)
    assert got(rows[:4], 16) == rows_of(names, cluster_by_hand(rows[:4], 16, 3, 5))
    assert got([]) == [] == got([(1, None)])
    big = spark.createDataFrame([(1, [3e7] * 5)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        C.cluster(spark, big, 2, 1, 5).collect()


def test_bounds_skip_no_centroid():
    """Survivors of the bound are verified in integers: nearest equals plain search, ties included."""
    rng = np.random.default_rng(6)
    x = rng.integers(-40, 40, (500, 24))
    centroids = np.vstack((x[:7], x[3:5], rng.integers(-3, 3, (4, 24))))
    axes = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    own, best = C.nearest(x, *C.rotate(x, axes, 6), centroids, axes)
    plain = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (own == plain.argmin(1)).all() and (best == plain.min(1)).all()
