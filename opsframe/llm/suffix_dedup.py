"""Removal of byte strings that repeat across documents: difference-cover suffix sorting to a bounded depth.

1. Texts become UTF-8 blocks of about 4 MB, stored once, bucketed by block number, so
   that the later joins move only what belongs to the texts and never the texts.
2. Sort the sample. Positions whose number modulo 21 is in a difference cover (5 of 21)
   are sampled: of any two equal 50-byte strings some sampled position lies at the same
   place within both, at most 20 bytes in, with 30 equal bytes behind it. The samples'
   30-byte tuples are range partitioned and sorted across the cluster, as hashes of as
   many bits as their number asks for, and a tuple that occurs once ends the suffixes
   that rest on it (discarding); equal hashes of unequal tuples only keep more.
3. Recurse on what is left. The surviving suffixes, cut where the least 16-byte seed of
   their 50 bytes changes, go to the range of that seed, a stretch of suffixes as one
   string; equal stretches of a block travel once.
4. Merge and compare. Within a range all suffixes are ordered, neighbours are compared
   over their whole 50 bytes, and every class of equal prefixes gets its least doc_id.
   A suffix of a larger doc_id is cut from its document.

Order within a range is that of a mixed key of the 50 bytes, not the alphabet's: equal
prefixes are neighbours either way, which is all that the comparison asks for. Where two
different prefixes share a key, the range is sorted again by the bytes themselves, so the
result is exact.

Defined cases: null text is empty; texts under 50 bytes stay whole; documents of equal
doc_id never remove each other's bytes; a null doc_id neither removes nor loses bytes;
repeated rows each count; an empty table gives no rows; extra columns are ignored. A text
is one row of its table and of its block, however long; arrays over it are made for 4 MB at a time,
but for 21 bytes a byte of the longest text in its block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import materialize, shared_dir

WINDOW = 50
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
TUPLE = WINDOW - PERIOD + 1
SEED = 16
#: Suffixes of a block that are worked on at a time, and bytes of text that a range of tuples or of suffixes is made for.
UNIT, TUPLE_RANGE, RANGE = 1 << 22, 1 << 23, 1 << 21

_BLOCK = "block long, ids binary, known binary, lengths binary, text binary"
_SPANS = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def loosen(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one integer; zeros follow the end."""
    size = -(-len(text) // 8) * 8
    padded = np.zeros(size + 8, np.uint8)
    padded[: len(text)] = text
    out = np.empty(size, np.uint64)
    for o in range(8):
        out[o::8] = padded[o : o + size].view(np.uint64)
    return out


def mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        h ^= part
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] times, for every i."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def edges(bits: int, ranges: int) -> np.ndarray:
    """Where each range but the first begins among numbers of so many bits."""
    return np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)


class Block:
    """A stored block: its bytes, and for each byte what is left of its document (0 where the id is null)."""

    def __init__(self, row: dict):
        self.ids, self.lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
        self.known = np.frombuffer(row["known"], np.bool_)
        self.text = np.frombuffer(zstandard.decompress(row["text"]) if self.lengths.sum() else b"", np.uint8)
        self.ends = np.cumsum(self.lengths)

    def units(self) -> Iterator["Unit"]:
        for number, a in enumerate(range(0, len(self.text), UNIT)):
            yield Unit(self, number, a, min(a + UNIT, len(self.text)))


class Unit:
    """The suffixes of a block from a to b, and the bytes that they need."""

    def __init__(self, block: Block, number: int, a: int, b: int):
        self.number, self.a, self.n = number, a, b - a
        upto = min(b + PERIOD + WINDOW, len(block.text))
        self.bytes = block.text[a:upto]
        self.words = words(np.concatenate((self.bytes, np.zeros(2 * WINDOW, np.uint8))))
        doc = self._docs(block, a, upto)
        self.row = doc
        room = block.ends[doc] - np.arange(a, upto)
        room[~block.known[doc]] = 0
        self.room = np.minimum(room, WINDOW).astype(np.uint8)

    @staticmethod
    def _docs(block: Block, a: int, b: int) -> np.ndarray:
        """The row of each byte: empty documents have none."""
        starts = block.ends - block.lengths
        inside = np.clip(np.minimum(block.ends, b) - np.maximum(starts, a), 0, None)
        return np.repeat(np.arange(len(inside), dtype=np.int32), inside)

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places (from a) of this unit, those just behind it included, and their tuples' hashes."""
        upto = min(self.n + PERIOD - 1, len(self.bytes))
        place = np.arange(upto)[np.resize(np.isin((np.arange(PERIOD) + self.a) % PERIOD, COVER), upto)]
        place = place[self.room[place] >= TUPLE]
        w = self.words
        return place, mixed(w[place], w[place + 8], w[place + 16], w[place + TUPLE - 8]) >> np.uint64(64 - bits)

    def survivors(self, place: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Suffixes of 50 bytes that rest on a sample that is kept."""
        marks = np.zeros(self.n + PERIOD + 1, np.int32)
        marks[place[kept] + 1] = 1
        upto = np.cumsum(marks)
        near = upto[PERIOD : PERIOD + self.n] > upto[: self.n]
        return np.flatnonzero(near & (self.room[: self.n] >= WINDOW))

    def stretches(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First suffix, number of suffixes and least seed of each stretch of consecutive suffixes."""
        seeds = mixed(self.words[: self.n + WINDOW], self.words[8 : self.n + WINDOW + 8])
        wide, least = 1, seeds
        while 2 * wide <= WINDOW - SEED + 1:
            least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
        rest = WINDOW - SEED + 1 - wide
        least = np.minimum(least[: len(least) - rest], least[rest:])[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        return starts[first], np.diff(np.append(first, len(starts))), mixed(least[first])


def _blocks(docs: DataFrame) -> DataFrame:
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"), F.spark_partition_id().alias("part"))

    def packed(part: int, number: int, ids: list, texts: list) -> pa.RecordBatch:
        row = ((part << 32) + number, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids]).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), zstandard.compress(b"".join(texts), 3))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 4))], ["block", "ids", "known", "lengths", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, number, part = [], [], 0, 0, 0
        for batch in batches:
            for i, t, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids.append(i), texts.append(t.as_py())
                held += len(texts[-1]) + 16
                if held >= UNIT:
                    yield packed(part, number, ids, texts)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield packed(part, number, ids, texts)

    return source.mapInArrow(run, _BLOCK)


def _stored(spark: SparkSession, blocks: DataFrame, buckets: int) -> DataFrame:
    name = f"blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/opsframe/{name}").saveAsTable(name)
    stored = spark.table(name)
    # only the name goes out of the catalog: the frame has the files and their buckets
    spark.sql(f"DROP TABLE {name}")
    return stored


def _batch(rows: list[tuple], names: str, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names.split())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def repeated_samples(blocks: DataFrame, bits: int, ranges: int) -> DataFrame:
    """(block, unit, range, bits): which of a unit's distinct tuples in a range occur in other units, too."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = edges(bits, ranges)
        for row in _rows(batches):
            for unit in Block(row).units():
                keys = np.unique(unit.samples(bits)[1])
                at = [0, *np.searchsorted(keys, cut), len(keys)]
                rows = [(row["block"], unit.number, r, squeeze(np.diff(keys[x:y], prepend=np.uint64(0)))) for r, (x, y) in enumerate(zip(at, at[1:])) if y > x]
                if rows:
                    yield _batch(rows, "block unit range keys", (pa.int64(), pa.int32(), pa.int32(), pa.binary()))

    def meet(group: pa.Table) -> pa.Table:
        packets = [np.cumsum(loosen(k.as_py(), np.uint64)) for k in group.column("keys")]
        every = np.sort(np.concatenate(packets))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        rows = []
        for block, unit, number, keys in zip(*(group.column(c).to_pylist() for c in ("block", "unit", "range")), packets):
            if len(twice):
                found = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
                if found.any():
                    rows.append((block, unit, number, np.packbits(found).tobytes()))
        return pa.Table.from_batches([_batch(rows, "block unit range bits", (pa.int64(), pa.int32(), pa.int32(), pa.binary()))])

    packets = blocks.mapInArrow(sample, "block long, unit int, range int, keys binary")
    return packets.groupBy("range").applyInArrow(meet, "block long, unit int, range int, bits binary")


def _distinct(text: bytes, first: np.ndarray, counts: np.ndarray, docs: np.ndarray, seeds: np.ndarray, cut: np.ndarray) -> Iterator[tuple]:
    """Packets of the distinct stretches, one a range: range, contents, runs, copies, starts, docs."""
    numbers: dict[bytes, int] = {}
    own = np.array([numbers.setdefault(text[s : s + r + WINDOW - 1], len(numbers)) for s, r in zip(first.tolist(), counts.tolist())], np.int64)
    contents = list(numbers)
    place = np.searchsorted(cut, seeds, "right")
    order = np.lexsort((own, place))
    place, own = place[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    heads = np.flatnonzero(new)
    copies = np.diff(np.append(heads, len(own)))
    for r in np.unique(place):
        x, y = np.searchsorted(place[heads], (r, r + 1))
        members = order[heads[x] : heads[y - 1] + copies[y - 1]]
        runs = counts[order[heads[x:y]]]
        yield int(r), zstandard.compress(b"".join(contents[i] for i in own[heads[x:y]]), 3), squeeze(runs.astype(np.uint32)), squeeze(copies[x:y].astype(np.uint32)), squeeze(first[members].astype(np.uint32)), squeeze(docs[members])


def least_documents(contents: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each 50-byte prefix at offsets: the least id of docs among all equal ones."""
    w = words(contents)
    parts = [w[offsets + o] for o in (*range(0, WINDOW - 7, 8), WINDOW - 8)]
    key = mixed(*parts)
    order = np.argsort(key)
    key = key[order]
    equal = np.ones(len(order), bool)
    for part in parts:
        here = part[order]
        equal[1:] &= here[1:] == here[:-1]
    if (~equal[1:] & (key[1:] == key[:-1])).any():
        order = np.lexsort(parts)
        equal[:] = True
        for part in parts:
            here = part[order]
            equal[1:] &= here[1:] == here[:-1]
    equal[:1] = False
    heads = np.flatnonzero(~equal)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(docs[order], heads), np.diff(np.append(heads, len(order))))
    return out


def removed_in_range(contents: np.ndarray, runs: np.ndarray, copies: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch (a copy's number), first byte and end of what is cut from its block."""
    width = runs + WINDOW - 1
    offsets = np.cumsum(width) - width
    of = np.repeat(np.arange(len(runs)), copies)
    own = np.minimum.reduceat(docs, np.cumsum(copies) - copies)
    least = least_documents(contents, ragged(offsets, runs), np.repeat(own, runs))
    whole = np.flatnonzero(docs > own[of])
    part = np.flatnonzero(docs == own[of])
    run, copy = runs[of[part]], np.repeat(part, runs[of[part]])
    cut = least[ragged((np.cumsum(runs) - runs)[of[part]], run)] < docs[copy]
    at = ragged(starts[part], run)[cut]
    copy = copy[cut]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (copy[1:] != copy[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads, len(at))[1:] - 1
    return np.append(whole, copy[heads]), np.append(starts[whole], at[heads]), np.append(starts[whole] + width[of[whole]], at[tails] + WINDOW)


def removed_bytes(blocks: DataFrame, bits: int, tuple_ranges: int, ranges: int) -> DataFrame:
    """(block, starts, ends): bytes of blocks that are cut, as packed numbers; they may overlap."""

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tuple_cut, cut = edges(bits, tuple_ranges), edges(64, ranges)
        for row in _rows(batches):
            block = Block(row)
            told = {(r["unit"], r["range"]): r["bits"] for r in row["repeated"] or ()}
            for unit in block.units():
                place, key = unit.samples(bits)
                keys, often = np.unique(key, return_counts=True)
                keep = often > 1
                at = [0, *np.searchsorted(keys, tuple_cut), len(keys)]
                for r, (x, y) in enumerate(zip(at, at[1:])):
                    if y > x and (unit.number, r) in told:
                        keep[x:y] |= np.unpackbits(np.frombuffer(told[unit.number, r], np.uint8), count=y - x).astype(bool)
                if not keep.any():
                    continue
                size = 1 << max(8, int(16 * keep.sum()).bit_length())
                known = np.zeros(size, bool)
                known[(keys[keep] & np.uint64(size - 1)).astype(np.int64)] = True
                starts = unit.survivors(place, known[(key & np.uint64(size - 1)).astype(np.int64)])
                if not len(starts):
                    continue
                first, counts, seeds = unit.stretches(starts)
                rows = []
                for r, contents, runs, copies, starts, docs in _distinct(unit.bytes.tobytes(), first, counts, block.ids[unit.row[first]], seeds, cut):
                    rows.append((row["block"], unit.a, r, contents, runs, copies, starts, docs))
                yield _batch(rows, "block base range contents runs copies starts docs", (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5))

    def merge(group: pa.Table) -> pa.Table:
        parts = {c: [v.as_py() for v in group.column(c)] for c in ("contents", "runs", "copies", "starts", "docs")}
        contents = np.frombuffer(b"".join(zstandard.decompress(c) for c in parts["contents"]), np.uint8)
        columns = {c: [loosen(v, k) for v in parts[c]] for c, k in (("runs", np.uint32), ("copies", np.uint32), ("starts", np.uint32), ("docs", np.int64))}
        packet = np.repeat(np.arange(group.num_rows), [len(v) for v in columns["starts"]])
        base = group.column("base").to_numpy()
        flat = {c: np.concatenate(v).astype(np.int64) for c, v in columns.items()}
        copy, starts, ends = removed_in_range(contents, flat["runs"], flat["copies"], flat["starts"], flat["docs"])
        order = np.argsort(packet[copy], kind="stable")
        owner, starts, ends = packet[copy][order], starts[order], ends[order]
        blocks_of = group.column("block").to_pylist()
        rows = []
        for p in np.unique(owner):
            x, y = np.searchsorted(owner, (p, p + 1))
            rows.append((blocks_of[p], squeeze(starts[x:y] + base[p]), squeeze(ends[x:y] + base[p])))
        return pa.Table.from_batches([_batch(rows, "block starts ends", (pa.int64(), pa.binary(), pa.binary()))])

    packets = blocks.mapInArrow(survive, "block long, base long, range int, contents binary, runs binary, copies binary, starts binary, docs binary")
    return packets.groupBy("range").applyInArrow(merge, "block long, starts binary, ends binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        block = Block(row)
        depth = np.zeros(len(block.text) + 1, np.int32)
        for piece in row["removed"] or ():
            np.add.at(depth, loosen(piece["starts"], np.int64), 1)
            np.add.at(depth, loosen(piece["ends"], np.int64), -1)
        gone = np.cumsum(depth[:-1]) > 0
        ids, spans, kept = [], [], []
        for i, known, end, n in zip(block.ids.tolist(), block.known.tolist(), block.ends.tolist(), block.lengths.tolist()):
            mask, text = gone[end - n : end], block.text[end - n : end]
            turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()
            ids.append(i if known else None)
            spans.append([{"start": s, "end": e} for s, e in zip(turns[::2], turns[1::2])])
            kept.append(text[~mask].tobytes() if turns else text.tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(block.lengths), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte runs: start, end) and kept (the remaining bytes) of each row of docs."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _stored(spark, _blocks(docs), buckets)
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    tuple_ranges, ranges = max(buckets, total // TUPLE_RANGE + 1), max(buckets, total // RANGE + 1)
    bits = min(60, (total * len(COVER) // PERIOD).bit_length() + 8)
    repeated = materialize(spark, repeated_samples(blocks, bits, tuple_ranges), "repeated_samples")
    told = repeated.groupBy("block").agg(F.collect_list(F.struct("unit", "range", "bits")).alias("repeated"))
    removed = materialize(spark, removed_bytes(blocks.join(told.hint("shuffle_hash"), "block", "left"), bits, tuple_ranges, ranges), "removed_bytes")
    pieces = removed.groupBy("block").agg(F.collect_list(F.struct("starts", "ends")).alias("removed"))
    return blocks.join(pieces.hint("shuffle_hash"), "block", "left").mapInArrow(_cut, _SPANS)


def removal_digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 out of remove_repeats' rows."""
    return spans.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
