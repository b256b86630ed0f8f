"""N-gram Jaccard join with Bayesian candidate pruning.

Words are runs of ASCII letters and digits (case folded) and non-ASCII characters;
a text's set is that of its windows of five words, as 64-bit hashes (a text of one
to four words is one window, one of none is known by its text alone). Rows with the
same set are one copy class and enter the join once.

Candidates share one of BANDS buckets of ROWS MinHash values each. The members of a
bucket meet under its least member, their leader, so that copies which share many
buckets meet once and not once a bucket; a pair is looked at only under the least
leader both have. Large leader groups are cut into blocks and each pair of blocks
is a piece of work of its own, whose output is one row a member with its number of
links and its local component, never one a pair. In a pair of blocks, MinHash values
are compared STEP at a time; a pair goes when the posterior probability that its
similarity reaches the threshold, with a uniform prior, falls below TOLERANCE. The
rest is verified exactly on the sets.

A pair at the threshold shares no bucket with probability (1 - 0.8^4)^32 = 5e-8.

Defined cases: null text counts as empty; rows with equal sets have similarity 1;
repeated rows and repeated or null ids are rows like others; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import materialize, sliced

WORDS = 5
THRESHOLD = (4, 5)  # 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-9
BLOCK = 256
SLAB = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLIERS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WINDOW = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b if b in _KEEP else 0x20 for b in range(256))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(raw: bytes) -> np.ndarray:
    """One hash a word, by prefix sums of a polynomial over the bytes."""
    n = len(raw)
    size = max(1 << 16, 1 << (n + 1).bit_length())
    if size not in _powers:
        _powers[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p, np.uint64)]) for p in (_P, _P_INVERSE))
    power, inverse = _powers[size]
    b = np.frombuffer(raw, np.uint8)
    inside = b != 0x20
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[b] * power[:n])]
    return _mix((sums[end] - sums[start]) * inverse[start])


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct window hashes of a text."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD)
    parts, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SLAB else raw.rfind(b" ", at, at + SLAB) + 1 or raw.find(b" ", at + SLAB) + 1 or len(raw)
        end = end if end > at else len(raw)
        parts.append(_word_hashes(raw[at:end]))
        at = end
    w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(w) == 0:
        return w
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, len(w) if len(w) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(w))):
        h += w[i : i + n] * _WINDOW[i]
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 1024):
        part = np.multiply.outer(_MULTIPLIERS, s[at : at + 1024])
        part >>= np.uint64(32)
        np.minimum(out, part.min(1).astype(np.uint32), out=out)
    return out


def set_key(s: np.ndarray, text: str | None) -> tuple[int, int]:
    data = s.tobytes() if len(s) else b"text" + (text or "").encode("utf-8", "surrogatepass")
    return tuple(np.array([xxhash.xxh3_64_intdigest(data, seed) for seed in (1, 2)], np.uint64).view(np.int64).tolist())


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = 0..HASHES compared values, the fewest matches at which P(similarity >= threshold) >= tolerance."""
    grid = (np.arange(4000) + 0.5) / 4000
    high = grid >= threshold
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[high].sum() >= tolerance * weight.sum():
                out[n] = m
                break
    return out


def linked(rows_a: list, rows_b: list | None, leader: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked pairs: within rows_a, or across rows_a and rows_b. A row is (node, size, leaders, set, signature)."""
    same = rows_b is None
    rows_b = rows_a if same else rows_b
    na, nb = (np.array([len(r[3]) for r in rows]) for rows in (rows_a, rows_b))
    top, bottom = THRESHOLD
    ok = (na[:, None] * bottom >= nb[None, :] * top) & (nb[None, :] * bottom >= na[:, None] * top)
    if same:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    lesser = {x: i for i, x in enumerate(sorted({x for rows in (rows_a, rows_b) for r in rows for x in r[2] if x < leader}))}
    if lesser:
        member = [np.zeros((len(rows), len(lesser)), np.float32) for rows in (rows_a, rows_b)]
        for table, rows in zip(member, (rows_a, rows_b)):
            for i, r in enumerate(rows):
                table[i, [lesser[x] for x in r[2] if x < leader]] = 1
        ok &= member[0] @ member[1].T == 0
    a, b = np.nonzero(ok)
    sig_a, sig_b = (np.array([r[4] for r in rows]) for rows in (rows_a, rows_b))
    matches = np.zeros(len(a), np.int64)
    for at in range(0, HASHES, STEP):
        if not len(a):
            return a, b
        matches += (sig_a[a, at : at + STEP] == sig_b[b, at : at + STEP]).sum(1)
        keep = matches >= need[at + STEP]
        a, b, matches = a[keep], b[keep], matches[keep]
    if len(a) <= 200:
        common = np.array([len(np.intersect1d(rows_a[i][3], rows_b[j][3], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    else:
        common = _common(rows_a, rows_b)[a, b]
    # common / (na + nb - common) >= top / bottom
    keep = common * (bottom + top) >= top * (na[a] + nb[b])
    return a[keep], b[keep]


def _common(rows_a: list, rows_b: list) -> np.ndarray:
    """Sizes of all intersections, as a matrix product over the shared windows, some columns at a time."""
    where = [np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows]) for rows in (rows_a, rows_b)]
    values = [np.concatenate([r[3] for r in rows]) for rows in (rows_a, rows_b)]
    shared = np.intersect1d(*values)
    out = np.zeros((len(rows_a), len(rows_b)), np.int64)
    spots = [np.searchsorted(shared, v) for v in values]
    hits = [(s < len(shared)) & (shared[np.minimum(s, len(shared) - 1)] == v) if len(shared) else np.zeros(len(v), bool) for s, v in zip(spots, values)]
    for at in range(0, len(shared), 4096):
        tables = []
        for rows, w, s, hit in zip((rows_a, rows_b), where, spots, hits):
            table = np.zeros((len(rows), min(4096, len(shared) - at)), np.float32)
            own = hit & (s >= at) & (s < at + 4096)
            table[w[own], s[own] - at] = 1
            tables.append(table)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text_hash, set_a, set_b, n, sig of each row."""
    source = docs.select(F.monotonically_increasing_id().alias("uid"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, sizes, sigs = [], [], []
            for text in batch.column(3).to_pylist():
                s = shingles(text)
                keys.append(set_key(s, text))
                sizes.append(len(s))
                sigs.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
                ["uid", "doc_id", "text_hash", "set_a", "set_b", "n", "sig"],
            )

    return source.mapInArrow(run, "uid long, doc_id long, text_hash long, set_a long, set_b long, n long, sig binary")


def _bands(signed: DataFrame) -> DataFrame:
    """(node, band) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
            for i in range(ROWS):
                h = _mix(h ^ sig[:, :, i])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(h.ravel().view(np.int64))], ["node", "band"])

    return signed.select("node", "sig").mapInArrow(run, "node long, band long")


def _verify(pieces: DataFrame) -> DataFrame:
    """pieces: rows of (leader, i, j) groups together. One row a linked member: node, links, root."""
    need = least_matches(THRESHOLD[0] / THRESHOLD[1])

    def work(key: tuple, rows: dict) -> Iterator[tuple[int, int, int]]:
        leader, i, j = key
        sides = ([r for r in rows.values() if r[5] == i], [r for r in rows.values() if r[5] == j]) if i != j else (list(rows.values()), None)
        if not sides[0] or sides[1] == []:
            return
        a, b = linked(sides[0], sides[1], leader, need)
        if not len(a):
            return
        left, right = sides[0], sides[0] if sides[1] is None else sides[1]
        root, links = {}, {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            u, v = left[x], right[y]
            links[u[0]] = links.get(u[0], 0) + v[1]
            links[v[0]] = links.get(v[0], 0) + u[1]
            p, q = find(u[0]), find(v[0])
            if p != q:
                root[max(p, q)] = min(p, q)
        for node, n in links.items():
            yield node, n, find(node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("leader", "i", "j", "node", "size", "leaders", "windows", "block")]
            for leader, i, j, node, size, leaders, windows, block in zip(*columns):
                if (leader, i, j) != key:
                    out += work(key, rows) if len(rows) > 1 else ()
                    key, rows = (leader, i, j), {}
                s = np.frombuffer(windows, np.uint64)
                rows[node] = (node, size, leaders, s, signature(s), block)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["node", "links", "root"])
        if len(rows) > 1:
            out = list(work(key, rows))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["node", "links", "root"])

    return pieces.mapInArrow(run, "node long, links long, root long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component): the least node each node of (u, v) can reach, by alternating large and small stars."""
    stars = materialize(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        stars = materialize(spark, small, "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def repeated(prints: DataFrame) -> bool:
    """Whether any row stands there twice, with its id and text."""
    return prints.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0


def join_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """uid, doc_id, text_hash, class_id, copy_id, n_links for each row of docs.

    class_id is the least doc_id of the row's connected component of links, copy_id
    that of its copy class; n_links counts the other rows whose similarity is 0.8 or more.
    """
    prints = materialize(spark, fingerprints(docs), "prints")
    copies = materialize(
        spark,
        prints.groupBy("set_a", "set_b").agg(F.min("uid").alias("node"), F.count("*").alias("size"), F.min("doc_id").alias("copy_id"), F.max("n").alias("n")),
        "copies",
    )
    firsts = prints.select(F.col("uid").alias("node"), F.col("doc_id").alias("first_doc"), F.col("text_hash").alias("first_hash"), "sig").join(copies.where("n > 0").select("node", "size", "set_a", "set_b"), "node")
    firsts = materialize(spark, firsts, "firsts")
    bands = _bands(firsts)
    buckets = bands.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1").select("band", "leader")
    meets = materialize(spark, bands.join(buckets, "band").select("leader", "node").distinct(), "meets")
    groups = meets.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    led = meets.join(groups, "leader").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("leader", "blocks"))).alias("led"))
    wanted = led.join(firsts.select("node", "first_doc", "first_hash", "size", "set_a", "set_b"), "node")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    if repeated(prints):
        texts = texts.dropDuplicates(["doc_id", "text_hash"])
    # by id and text, so that null or repeated ids meet only where the text is the same, too
    chosen = texts.join(wanted, on=[texts["text_hash"] == wanted["first_hash"], texts["doc_id"].eqNullSafe(wanted["first_doc"])]).select("text", "set_a", "set_b", "node", "size", "led")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(shingles(t), t) for t in batch.column(0).to_pylist()]
            own = [set_key(*f) for f in found]
            keep = pa.array([k == (a, b) for k, a, b in zip(own, batch.column(1).to_pylist(), batch.column(2).to_pylist())], pa.bool_())
            windows = pa.array([s.tobytes() for s, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], windows], ["node", "size", "led", "windows"]).filter(keep)

    led_type = "array<struct<leader:long,blocks:int>>"
    placed = chosen.mapInArrow(sets, f"node long, size long, led {led_type}, windows binary")
    placed = placed.select("node", "size", F.transform("led", lambda x: x["leader"]).alias("leaders"), "windows", F.explode("led").alias("at"))
    placed = placed.select("node", "size", "leaders", "windows", F.col("at.leader").alias("leader"), F.pmod(F.xxhash64("node"), F.col("at.blocks")).cast("int").alias("block"), F.col("at.blocks").alias("blocks"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", partner).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    sorted_ = placed.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    links = materialize(spark, _verify(sorted_), "links")
    comps = components(spark, links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        copies.join(counted, "node", "left")
        .join(comps, "node", "left")
        .select("set_a", "set_b", "copy_id", F.coalesce("component", "node").alias("component"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    known = materialize(spark, known, "known")
    classes = known.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    named = known.join(classes, "component").select("set_a", "set_b", "class_id", "component", "copy_id", "n_links")
    return prints.select("uid", "doc_id", "text_hash", "set_a", "set_b").join(named, ["set_a", "set_b"]).drop("set_a", "set_b")


def ngram_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_id, n_links: one row for each row of docs."""
    return join_classes(spark, docs).select("doc_id", "class_id", "copy_id", "n_links")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows, all their columns, of which one stays for each class: that with the least doc_id, of equal ones any.

    Of rows that repeat an id and a text, but differ in other columns, one stays, too.
    """
    rows = materialize(spark, join_classes(spark, docs), "classes")
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "uid")).alias("best")).select(F.col("best.uid").alias("uid"))
    kept = rows.join(best, "uid").select("doc_id", "text_hash")
    # numbered names, so that no column of docs is taken for one of these
    own = [f"c{i}" for i in range(len(docs.columns))]
    doc, text = (own[docs.columns.index(c)] for c in ("doc_id", "text"))
    tagged = docs.toDF(*own).withColumn("hash", F.xxhash64(text))
    keys = kept.select(F.col("doc_id").alias("k_doc"), F.col("text_hash").alias("k_hash"))
    out = tagged.join(keys, on=[tagged[doc].cast("long").eqNullSafe(keys["k_doc"]), tagged["hash"] == keys["k_hash"]], how="left_semi")
    if repeated(rows):
        out = out.dropDuplicates([doc, "hash"])
    return out.select(*own).toDF(*docs.columns)
