"""Best-fit packing of documents into token sequences, improved by local search.

A document's ids end with the id 0; longer ones are cut into pieces of CAPACITY.
Full pieces are sequences of their own. The others are dealt at random to groups
of about GROUP pieces, each packed by one task: best fit decreasing, then a local
search over the bins that are not full, which moves a document or exchanges one or
two for one whenever the sum of squared fills grows, until bins empty. What stands
in bins that are still far from full is dealt again to fewer groups, so the last
bin of a group costs nothing; this ends when one group remains.

Ids are those of the tokenizer library for each white-space-separated stretch,
which its pre-tokenizer never joins, kept in a bounded memory; texts with
characters for which that isn't certain go through the library whole.

Defined cases: null text counts as empty: one piece of length 1; repeated rows and
repeated or null ids are packed row by row; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import Memory, materialize, sliced

CAPACITY = 2048
GROUP = 4096
#: Bins that lack more than this share of the capacity are dealt again, so often at most.
SLACK = 256
ROUNDS = 8
#: Bytes of the memories of ids, of stretches and of words, that a worker keeps for as long as it lives.
MEMO_BYTES, WORD_MEMO_BYTES = 36 << 20, 16 << 20

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, full long"
_PACKED = f"{_PIECES}, bin long, offset long, fill long"


#: Stretches that words are found in, as the tokenizer file has it (a fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: itself if printable, else one after the 256th."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class _WordIds(Memory):
    """Word to its ids, by the library's own model."""

    def __init__(self, model):
        super().__init__(WORD_MEMO_BYTES)
        self.tokens, self.letters = model.tokenize, byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(word)
        return self.keep(word, ids, len(ids))

    def ids(self, word: str) -> bytes:
        """A word's ids, not remembered; printable ASCII is written as itself."""
        found = self.tokens(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])


class WordIds(Memory):
    """Stretch between blanks to its ids as little-endian unsigned 32-bit."""

    #: Characters of which NFC, lower-casing and white space are the same here and in the library; İ is not among them.
    UNSURE = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ‐-‧‰-⁞₠-₿А-яぁ-ゖァ-ヺ一-鿿가-힣]")

    def __init__(self, path: str):
        super().__init__(MEMO_BYTES)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = _WordIds(self.library.model)
        self.split = regex.compile(WORD).findall

    def __missing__(self, stretch: str) -> bytes:
        # a stretch of letters is one word: remembered here, not once more among the words
        if stretch.isalpha():
            ids = self.words.get(stretch) or self.words.ids(stretch)
        else:
            ids = b"".join(map(self.words.__getitem__, self.split(stretch)))
        return self.keep(stretch, ids, len(ids))

    def of(self, text: str) -> bytes:
        if "<|" in text or self.UNSURE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One memory for all tasks that a Python worker runs."""
    return WordIds(path)


def full_sequence(partition: int, number: int) -> int:
    """The sequence of a partition's full piece: odd numbers, for 2^22 partitions of 2^40 pieces each."""
    return partition << 41 | number << 1 | 1


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """uid (of the row), doc_id, piece, start, length, ids_crc32, full (the sequence of a full piece, else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        arrow = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        number = 0
        for batch in sliced(batches):
            rows = []
            for uid, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = words.of(text or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    whole = len(part) == 4 * capacity
                    # a task has one partition, which stands in the upper bits of its rows' numbers
                    rows.append((uid, doc, k, at // 4, len(part) // 4, zlib.crc32(part), full_sequence(uid >> 33, number) if whole else None))
                    number += whole
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "full"])

    return docs.select(F.monotonically_increasing_id().alias("uid"), docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: bins of item numbers. `room` has bit r set if a bin with r left exists."""
    by_room: dict[int, list[int]] = defaultdict(list)
    room, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if fits := room >> n:
            r = (fits & -fits).bit_length() - 1 + n
            b = by_room[r].pop()
            if not by_room[r]:
                room &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[r - n].append(b)
        room |= 1 << (r - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: the emptiest bins give documents to fuller ones while the squared fill grows."""
    size = np.array(lengths, np.int64)
    fill = np.array([size[b].sum() for b in bins], np.int64)
    owner = np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        owner[b] = k
    content = [set(b) for b in bins]
    queue = [(int(fill[k]), k) for k in range(len(bins)) if fill[k] < capacity]
    heapq.heapify(queue)
    while queue:
        f, a = heapq.heappop(queue)
        if f != fill[a] or f == 0:
            continue
        if step := _best_exchange(a, content[a], size, fill, owner, capacity):
            give, take, b = step
            for i, to in [(i, b) for i in give] + [(i, a) for i in take]:
                content[owner[i]].discard(i)
                content[to].add(i)
                fill[owner[i]] -= size[i]
                fill[to] += size[i]
                owner[i] = to
            for k in (a, b):
                if 0 < fill[k] < capacity:
                    heapq.heappush(queue, (int(fill[k]), k))
    return [sorted(c) for c in content if c]


def _best_exchange(a: int, own: set[int], size: np.ndarray, fill: np.ndarray, owner: np.ndarray, capacity: int) -> tuple | None:
    """The exchange of bin a with another bin that adds most to the sum of squares: a move, one for one, or two for one."""
    best, found = 0, None
    items = sorted(own, key=lambda i: (-size[i], i))
    giving = [((i,), int(size[i])) for i in items]
    seen: set[int] = set()
    # two of each length are enough for all sums of two, and a bin holds few lengths
    few = [i for x, i in enumerate(items) if x < 2 or size[items[x - 2]] != size[i]]
    giving += [((i, j), int(size[i] + size[j])) for x, i in enumerate(few) for j in few[x + 1 :]]
    other = np.arange(len(fill)) != a
    for give, n in giving:
        if n in seen:
            continue
        seen.add(n)
        if len(give) == 1:
            gain = np.where(other & (fill > 0) & (fill + n <= capacity), (fill + n) ** 2 - fill**2 + (fill[a] - n) ** 2 - fill[a] ** 2, 0)
            if gain[b := int(gain.argmax())] > best:
                best, found = int(gain[b]), (give, (), b)
        home = fill[owner]
        delta = n - size
        gain = np.where((owner != a) & (delta > 0) & (home + delta <= capacity), (home + delta) ** 2 - home**2 + (fill[a] - delta) ** 2 - fill[a] ** 2, 0)
        if gain[i := int(gain.argmax())] > best:
            best, found = int(gain[i]), (give, (i,), int(owner[i]))
    return found


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["uid", "piece"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        number, offset, fills = (np.empty(len(pdf), np.int64) for _ in range(3))
        for k, content in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in content:
                number[i], offset[i] = k, at
                at += lengths[i]
            fills[content] = at
        return pdf.assign(bin=number + (pdf["group"].to_numpy() << 16), offset=offset, fill=fills).drop(columns="group")

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    pieces = materialize(spark, cut_pieces(docs, tokenizer_path, capacity), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity)
    # odd numbers are those of full pieces, even ones the packed bins'
    done = [full.select(*columns, F.col("full").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, level, nearly = pieces.where(F.col("length") < capacity), 0, capacity - capacity // SLACK
    while True:
        n = rest.count()
        groups = max(1, -(-n // group))
        keyed = rest.withColumn("group", F.pmod(F.xxhash64("uid", "piece", F.lit(level)), F.lit(groups)))
        packed = materialize(spark, keyed.groupBy("group").applyInPandas(_pack_group(capacity), _PACKED), f"packed-{level}")
        last = groups == 1 or level == ROUNDS - 1
        kept = packed if last else packed.where(F.col("fill") >= nearly)
        done.append(kept.select(*columns, (F.shiftleft(F.col("bin"), 4) + 2 * level).alias("sequence_id"), "offset"))
        if last:
            break
        rest, level = packed.where(F.col("fill") < nearly).select(*pieces.columns), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
