"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut between neighbours that no piece holds, so that no piece crosses a cut;
no piece crosses the start of a word (a run of spaces with what follows up to the next space) either.
Every distinct fragment is exploded into its substrings of at most the longest
piece's length; an equi-join with the piece table keeps those that are pieces: the
edges of the fragment's lattice. Edges are grouped by fragment (of a fragment no longer than the
longest piece only the longest edge of each end, which implies the others), and Spark's
higher-order aggregate runs Viterbi over the ends from left to right. Its weights
depend on the kind of model:

- unigram models: an edge weighs its score, and the best sum wins;
- BPE models: scores are ranks of merges, whose best sum is another segmentation
  than the library's. There an edge weighs nothing if it fits the last edge of the
  best path to its start, and is forbidden if not; exactly one edge fits at each
  end. Two edges fit if no merge crosses from one to the other while both are
  built. A merge that could cross is itself an edge of the lattice whose own last
  merge is at the seam, so the test compares three edges by the times at which
  their parts arise and vanish, which the piece table holds.

The fold works through blocks of ends and keeps the last ones only, so its cost
is linear in a fragment's length.

The ids of frequent fragments (at most FREQUENT, and FREQUENT_BYTES) go to all
tasks. Texts are shuffled once, as numbers of their fragments, a block of texts a row; a block's other
fragments are joined by two shuffles, each once a block. A text's ids are then
decoded as a whole; round_trip says whether that gives the text again, by SHA-256.

Defined cases: null text counts as empty: no pieces; characters outside the table
become the pieces of their UTF-8 bytes; a text with U+2581 decodes with a space there, as by the
library, and has no round trip; repeated rows and repeated or null ids are
kept apart by a stored row number; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import cached_property
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import materialize

SPACE = "▁"
FREQUENT = 1 << 19
FREQUENT_BYTES = 1 << 24
#: Fragments (those of each block once), and bytes of texts, that a task counts before they are sent on.
COUNTED, COUNTED_CHARS = 1 << 19, 1 << 25
#: Texts of a block, and their bytes; a longer text is a block of its own.
TEXTS, BLOCK_BYTES = 1024, 1 << 21
#: Below the least score, as the library has it for characters that are no piece.
UNKNOWN = 10.0
#: Later than any merge.
NEVER = (1 << 20) - 1
#: Numbers of edges from here on are characters that are no piece.
NO_PIECE = 1 << 20


def derivation(piece: str, rank: dict[str, int]) -> list[tuple[int, int, int, int]]:
    """The merges of a piece's own encoding in order: (rank, start, middle, end)."""
    cuts, steps = list(range(len(piece) + 1)), []
    while len(cuts) > 2:
        pairs = [(r, i) for i in range(len(cuts) - 2) if (r := rank.get(piece[cuts[i] : cuts[i + 2]])) is not None]
        if not pairs:
            break
        r, i = min(pairs)
        steps.append((r, cuts[i], cuts[i + 1], cuts[i + 2]))
        del cuts[i + 1]
    return steps


def times(piece: str, steps: list[tuple[int, int, int, int]]) -> tuple[list[int], list[int]]:
    """For each prefix and each suffix by length: when it arises and vanishes in the piece's encoding, packed; 0 if it never stands there.

    A merge's time is the worst rank up to it, which is the order in which merges of two pieces
    side by side come; worst is the worst rank from a part's rise to its end.
    """
    n = len(piece)
    clock = [0]
    for r, *_ in steps:
        clock.append(max(clock[-1], r))
    born = {(i, i + 1): 0 for i in range(n)} | {(s, e): i + 1 for i, (_, s, _, e) in enumerate(steps)}
    gone = {part: i + 1 for i, (_, s, m, e) in enumerate(steps) for part in ((s, m), (m, e))}

    def packed(part: tuple[int, int]) -> int:
        if part not in born:
            return 0
        b, g = born[part], gone.get(part)
        dies, worst = (NEVER, NEVER) if g is None else (clock[g], max(r for r, *_ in steps[b:g]))
        return (clock[b] << 40) + (dies << 20) + worst

    return [packed((0, k)) for k in range(1, n + 1)], [packed((n - k, n)) for k in range(1, n + 1)]


class Pieces:
    """A model file's pieces, the ids of bytes, and whether it is a BPE model."""

    def __init__(self, path: str, model_type: str | None = None):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm = model.normalizer_spec
        if norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
            raise ValueError("only models without normalization and with a leading space")
        self.bpe = (model_type or {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]) == "bpe"
        self.rows = [(p.piece.replace(SPACE, " "), i, float(p.score)) for i, p in enumerate(model.pieces) if p.type == p.NORMAL]
        self.bytes = [i for i, p in enumerate(model.pieces) if p.type == p.BYTE]
        if len(self.bytes) != 256 or self.bytes != list(range(self.bytes[0], self.bytes[0] + 256)):
            raise ValueError("byte pieces have to be there and in order")
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.least = min(s for _, _, s in self.rows)
        #: No piece holds other neighbours than these, so a text can be cut between all others.
        self.neighbours = {p[i : i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)}
        self.lines = not any("\n" in p for p in self.neighbours)
        if self.longest > 63 or len(model.pieces) >= NEVER:
            raise ValueError("pieces of more than 63 characters, or too many of them")
        if any(a != " " and b == " " for p, _, _ in self.rows for a, b in zip(p, p[1:])):
            raise ValueError("a piece crosses the start of a word")
        self.id_type = "<u2" if len(model.pieces) <= 1 << 16 else "<u4"

    def table(self) -> pa.Table:
        """One row a piece: k (its number here), piece, id, score, rank (of its merge), tail (length after its last merge), prefixes and suffixes (times), inner and merges (of all pieces that end where it ends, longest first: see edges_of)."""
        order = {s: i + 1 for i, s in enumerate(sorted({-s for _, _, s in self.rows}))}
        rank = {p: order[-s] for p, _, s in self.rows}
        out = []
        for piece, i, score in self.rows:
            steps = derivation(piece, rank) if self.bpe else []
            if self.bpe and len(steps) < len(piece) - 1:
                continue  # it does not encode to itself, so it is in no encoding
            out.append((len(out), piece, i, score, rank[piece], steps[-1][3] - steps[-1][2] if steps else 0, *(times(piece, steps) if self.bpe else ([], []))))
        known = {r[1]: (r[0], r[5], r[4]) for r in out}

        def inner(piece: str) -> tuple[list[int], list[int]]:
            parts = [part for i in range(len(piece)) if (part := piece[i:]) in known or len(part) == 1]
            found = [(len(part), *known.get(part, (NO_PIECE + ord(part[0]), 0, 0))) for part in parts]
            edges = [(-n << 34) + (63 - n << 28) + (tail << 22) + k for n, k, tail, _ in found]
            return edges, [(-tail << 34) + (n - tail << 28) + (tail << 22) + r for n, _, tail, r in found if tail]

        out = [(*r, *inner(r[1])) for r in out]
        names = ["k", "piece", "id", "score", "rank", "tail", "prefixes", "suffixes", "inner", "merges"]
        types = [pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4]
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)

    def fragments(self, word: str) -> list[str]:
        """The word cut between neighbours that no piece holds."""
        if self.neighbours.issuperset(map(add, word, word[1:])):
            return [word]
        cuts = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in self.neighbours]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    @cached_property
    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character, 0 if no piece holds it beside another, and which pairs of numbers are neighbours."""
        characters = sorted({ord(c) for pair in self.neighbours for c in pair})
        number = np.zeros(sys.maxunicode + 1, np.int32 if len(characters) < 1 << 15 else np.int64)
        number[characters] = np.arange(1, len(characters) + 1)
        held = np.zeros((len(characters) + 1, len(characters) + 1), bool)
        for a, b in self.neighbours:
            held[number[ord(a)], number[ord(b)]] = True
        return number, held

    def _begins(self, text: str) -> np.ndarray:
        """For each character whether no piece holds it and the one before it."""
        number, held = self._held
        codes = number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.ones(len(codes), bool)
        begins[1:] = ~held.ravel()[codes[:-1] * held.shape[1] + codes[1:]]
        return begins

    def fragments_of(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The fragments of all words in order, and how many each word has; as fragments(), many at once."""
        text = "".join(words)
        begins = self._begins(text)
        first = np.cumsum([0, *map(len, words)])
        begins[first[:-1]] = True
        at = np.flatnonzero(begins)
        bounds = at.tolist()
        return [text[a:b] for a, b in zip(bounds, [*bounds[1:], len(text)])], np.diff(np.searchsorted(at, first))

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The fragments of all texts in order, how many each text has, and how many words.

        A word is a run of spaces with what follows it; where no piece holds a newline and something else
        (lines), it also starts at each newline. A text has a space put in front, an empty one has not.
        """
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        characters = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        begins = self._begins(data.tobytes().decode())
        first, filled = np.searchsorted(characters, bounds), np.diff(bounds) > 0
        begins[first[:-1][filled]] = True
        at = np.flatnonzero(begins)
        offsets = np.append(characters[at], len(data)).astype(np.int32)
        spaces = data == ord(" ")
        words = spaces.copy()
        words[1:] &= ~spaces[:-1]
        words[bounds[:-1][filled]] = True
        if self.lines:
            words |= data == ord("\n")
        n_words = np.diff(np.searchsorted(np.flatnonzero(words), bounds))
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), np.diff(np.searchsorted(at, first)), n_words


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, cut into blocks of TEXTS and BLOCK_BYTES at most, by the texts in a column."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            whole = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right"))
            to = min(at + TEXTS, max(at + 1, whole))
            yield batch.slice(at, to - at)
            at = to


def let(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda variable, where a column would be written out at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# An edge as one long, which sorts by its end, longest first, as long edges fit most often: end (29 bits), 63 - length (6), length after its last merge (6), number of its piece (22).
def _end(e: Column) -> Column:
    return F.shiftright(e, 34).cast("int")


def _length(e: Column) -> Column:
    return F.lit(63) - _before(e)


def _before(merge: Column) -> Column:
    """The length before the seam, of a merge."""
    return F.shiftright(merge, 28).bitwiseAND(F.lit(63)).cast("int")


def _tail(e: Column) -> Column:
    return F.shiftright(e, 22).bitwiseAND(F.lit(63)).cast("int")


def _number(e: Column) -> Column:
    return e.bitwiseAND(F.lit((1 << 22) - 1)).cast("int")


CHUNK = 64


def _edge(found: DataFrame) -> Column:
    """The edge of a found piece without its end."""
    number = F.coalesce(found["k"], F.ascii(found["piece"]) + NO_PIECE)
    return F.shiftleft((F.lit(63) - found["len"]).cast("long"), 28) + F.shiftleft(F.coalesce(found["tail"], F.lit(0)).cast("long"), 22) + number


def short_lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """words (key, word, more columns) of at most `longest` characters with tops, array<long>: at each end its longest edge.

    The others that end there are ends of that piece, which the piece table has as `inner`. One column an end is an
    aggregate of fixed size, where a list of all edges would be sorted on disk.
    """
    ends = words.select("*", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("end"))
    spans = ends.select("*", F.explode(F.sequence(F.lit(1), F.col("end"))).alias("len"))
    spans = spans.withColumn("piece", F.substr("word", F.col("end") - F.col("len") + 1, F.col("len")))
    found = spans.join(F.broadcast(table.select("piece", "k", "tail")), "piece", "left").where("k is not null or len = 1")
    found = found.select(*words.columns, "end", _edge(found).alias("edge"))
    # the longest has the least number
    tops = [F.min(F.when(F.col("end") == e, F.col("edge"))).alias(f"e{e}") for e in range(1, longest + 1)]
    whole = found.groupBy(*words.columns).agg(*tops)
    return whole.select(*words.columns, F.slice(F.array(*(f"e{e}" for e in range(1, longest + 1))), F.lit(1), F.length("word")).alias("tops"))


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """key, n_chars and edges, array<long> in order of their ends, for words (key, word); an end that no piece of one character reaches has an edge of that character."""
    chunks = words.select("key", "word", F.length("word").alias("n"), F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(CHUNK))).alias("at"))
    # longer words come in chunks with what stands before them, so that no row carries a long word along
    before = F.least(F.lit(longest - 1), F.col("at"))
    chunks = chunks.select("key", "n", "at", before.alias("before"), F.substr("word", F.col("at") - before + 1, before + CHUNK).alias("chunk"))
    ends = chunks.select("key", "n", "at", "before", "chunk", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("n") - F.col("at")))).alias("e"))
    spans = ends.select("key", "n", (F.col("at") + F.col("e")).alias("end"), "before", "chunk", "e", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("before") + F.col("e")))).alias("len"))
    spans = spans.select("key", "n", "end", "len", F.substr("chunk", F.col("before") + F.col("e") - F.col("len") + 1, F.col("len")).alias("piece"))
    found = spans.join(F.broadcast(table.select("piece", "k", "tail")), "piece", "left").where("k is not null or len = 1")
    edge = F.shiftleft(F.col("end").cast("long"), 34) + _edge(found)
    return found.groupBy("key").agg(F.max("n").alias("n_chars"), F.sort_array(F.collect_list(edge)).alias("edges"))


# A merge as one long: its seam (29 bits), the length before and after it (6 each), its rank (22).
def _bpe_fits(facts: Column):
    """(left edge, right edge, merges near, their seam) -> whether no merge crosses it."""

    def vanishes(t: Column, rank: Column) -> Column:
        return t.bitwiseAND(F.lit(NEVER)) > rank

    def together(a: Column, b: Column) -> Column:
        """Whether a part of the left and one of the right stand at the same time."""
        born, dies = (lambda t: F.shiftright(t, 40)), (lambda t: F.shiftright(t, 20).bitwiseAND(F.lit(NEVER)))
        return (born(a) <= dies(b)) & (born(b) < dies(a))

    def crossed(merge: Column, suffixes: Column, prefixes: Column) -> Column:
        """Whether the merge comes before left and right are whole. Without such a suffix and prefix it can't."""
        rank = _number(merge)
        a, b = F.get(suffixes, _before(merge) - 1), F.get(prefixes, _tail(merge) - 1)
        return F.coalesce((b > 0) & vanishes(a, rank) & vanishes(b, rank - 1) & together(a, b), F.lit(False))

    def fits(left: Column, right: Column, merges: Column, start: Column) -> Column:
        suffixes, prefixes = (F.get(facts[name], F.least(_number(x), F.size(facts["ids"]) - 1)) for name, x in (("suffixes", left), ("prefixes", right)))
        return ~F.exists(merges, lambda m: (F.shiftright(m, 34) == start) & crossed(m, suffixes, prefixes))

    return fits


def _bpe_choice(facts: Column):
    """(last edges by end, index of an end in them, edge, merges near, whether the end has an edge) -> last edges: the edge that fits is added."""
    fits = _bpe_fits(facts)

    def choose(seen: Column, index, e: Column, merges: Column, found: Column) -> Column:
        def first(start: Column) -> Column:
            return let(F.get(seen, index(start).cast("int")), lambda left: (left < 0) | fits(left, e, merges, start))

        return F.when(~found & let(F.shiftright(e, 34) - _length(e), first), F.concat(seen, F.array(e))).otherwise(seen)

    return choose, "bigint", F.lit(-1).cast("long"), lambda entry: entry


def _unigram_choice(facts: Column, least: float):
    """As above; the last edge of the best path is kept, of equals the longest."""
    kind = "struct<score:double,len:int,edge:bigint>"

    def choose(seen: Column, index, e: Column, merges: Column, found: Column) -> Column:
        own = F.when(_number(e) < NO_PIECE, F.get(facts["scores"], _number(e))).otherwise(F.lit(least - UNKNOWN))
        scored = F.struct((F.get(seen, index(_end(e) - _length(e)))["score"] + own).alias("score"), _length(e).alias("len"), e.alias("edge")).cast(kind)
        last = F.get(seen, F.size(seen) - 1)
        return F.when(~found, F.concat(seen, F.array(scored))).when(scored > last, F.concat(F.slice(seen, F.lit(1), F.size(seen) - 1), F.array(scored))).otherwise(seen)

    start = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("len"), F.lit(-1).cast("long").alias("edge"))
    return choose, kind, start, lambda entry: entry["edge"]


def edges_of(tops: Column, facts: Column) -> Column:
    """array<array<long>>: the edges at each end, longest first, from the longest ones; they hold their starts instead of their ends."""

    def own(top: Column, i: Column) -> Column:
        end = F.shiftleft((i + 1).cast("long"), 34)
        known = lambda edges: F.transform(edges, lambda e: e + end)
        return F.when(_number(top) < NO_PIECE, known(F.get(facts["inner"], _number(top)))).otherwise(F.array(top + F.shiftleft(i.cast("long"), 34)))

    return F.transform(tops, own)


def short_fold(tops: Column, facts: Column) -> Column:
    """array<long>: the edges of the path whose edges all fit, in order, for a word in one block: see viterbi_fold."""
    fits = _bpe_fits(facts)
    start = lambda e: F.shiftright(e, 34)

    def merges(top: Column, i: Column) -> Column:
        end = F.shiftleft((i + 1).cast("long"), 34)
        # characters that are no piece have no merge
        return F.transform(F.coalesce(F.get(facts["merges"], _number(top)), F.array().cast("array<bigint>")), lambda m: m + end)

    def folded(merges: Column) -> Column:
        def chosen(seen: Column, own: Column) -> Column:
            def step(best: Column, e: Column) -> Column:
                fit = (start(e) == 0) | fits(F.get(seen, start(e).cast("int")), e, merges, start(e))
                return F.when(best >= 0, best).when(fit, e).otherwise(best)

            return F.aggregate(own, F.lit(-1).cast("long"), step)

        return F.aggregate(edges_of(tops, facts), F.array(F.lit(-1).cast("long")), lambda seen, own: F.array_append(seen, chosen(seen, own)))

    def back(path: Column, e: Column) -> Column:
        """An edge is on the path if the one after it starts at its end."""
        return F.when(F.coalesce(start(F.get(path, F.lit(0))) == start(e) + _length(e), F.lit(True)), F.array_prepend(path, e)).otherwise(path)

    last = let(F.flatten(F.transform(tops, merges)), folded)
    return F.aggregate(F.reverse(F.filter(last, lambda e: e >= 0)), F.array().cast("array<bigint>"), back)


def viterbi_fold(edges: Column, n: Column, choice: tuple, ranks: Column, block: int) -> Column:
    """array<long>: the edges of the best path in order. block is the longest piece's length: of earlier ends than that nothing is asked."""
    choose, kind, start, edge_of = choice
    blocks = F.sequence(F.lit(0), n - 1, F.lit(block))
    acc_type = f"struct<read:int,merges:array<bigint>,seen:array<{kind}>,done:array<array<bigint>>>"
    none = F.array().cast("array<bigint>")

    def merge(e: Column) -> Column:
        fields = F.shiftleft(_end(e).cast("long") - _tail(e), 34) + F.shiftleft((_length(e) - _tail(e)).cast("long"), 28) + F.shiftleft(_tail(e).cast("long"), 22)
        return fields + F.get(ranks, _number(e))

    first = F.struct(F.lit(0).alias("read"), none.alias("merges"), F.array_repeat(start, block).alias("seen"), F.array().cast("array<array<bigint>>").alias("done")).cast(acc_type)

    def forward(acc: Column, b: Column) -> Column:
        fresh = F.filter(F.slice(edges, acc["read"] + 1, F.lit(block * block)), lambda e: F.shiftright(e, 34) <= b + block)

        def with_fresh(fresh: Column) -> Column:
            own = F.transform(F.filter(fresh, lambda e: _tail(e) > 0), merge)
            index = lambda end: end - (b - block + 1)
            step = lambda merges: lambda seen, e: choose(seen, index, e, merges, F.size(seen) > index(F.shiftright(e, 34)))

            def with_seen(seen: Column) -> Column:
                chosen = F.transform(F.slice(seen, F.lit(block + 1), F.lit(block)), edge_of)
                return F.struct((acc["read"] + F.size(fresh)).alias("read"), own.alias("merges"), F.slice(seen, F.size(seen) - block + 1, F.lit(block)).alias("seen"), F.concat(acc["done"], F.array(chosen)).alias("done")).cast(acc_type)

            return let(let(F.concat(acc["merges"], own), lambda merges: F.aggregate(fresh, acc["seen"], step(merges))), with_seen)

        return let(fresh, with_fresh)

    def path(chosen: Column) -> Column:
        one, all_ = "struct<at:int,own:array<bigint>>", "struct<at:int,parts:array<array<bigint>>>"

        def inner(acc: Column, b: Column) -> Column:
            def step(a: Column, _: Column) -> Column:
                edge = F.get(chosen, a["at"] - 1)
                return F.when(a["at"] > b, F.struct((a["at"] - _length(edge)).alias("at"), F.concat(F.array(edge), a["own"]).alias("own")).cast(one)).otherwise(a)

            return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(block), n)), F.struct(acc["at"].alias("at"), none.alias("own")).cast(one), step)

        back = lambda acc, b: let(inner(acc, b), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["parts"], F.array(r["own"])).alias("parts")).cast(all_))
        begun = F.struct(n.alias("at"), F.array().cast("array<array<bigint>>").alias("parts")).cast(all_)
        return F.flatten(F.reverse(F.aggregate(F.reverse(blocks), begun, back)["parts"]))

    return let(F.flatten(F.aggregate(blocks, first, forward)["done"]), path)


def _byte_ids(code: Column, base: int) -> Column:
    """The byte pieces of a character's UTF-8."""
    low = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(63)) + 128 + base
    head = lambda shift, mark: F.shiftright(code, shift) + mark + base
    long = F.array(head(18, 0xF0), low(12), low(6), low(0))
    return F.when(code < 0x80, F.array(code + base)).when(code < 0x800, F.array(head(6, 0xC0), low(0))).when(code < 0x10000, F.array(head(12, 0xE0), low(6), low(0))).otherwise(long)


def encode_words(spark: SparkSession, words: DataFrame, pieces: Pieces) -> DataFrame:
    """words (key, word, more columns) with ids array<int>; pass a stored table."""
    table = spark.createDataFrame(pieces.table())
    count = pieces.table().num_rows
    never = [NEVER << 20 | NEVER]
    none = spark.createDataFrame([(count, 0.0, 0, -1, never, never, [], [])], "k int, score double, rank int, id int, prefixes array<long>, suffixes array<long>, inner array<long>, merges array<long>")
    fields = {"ids": "id", "scores": "score", "ranks": "rank", "prefixes": "prefixes", "suffixes": "suffixes", "inner": "inner", "merges": "merges"}
    # all pieces as one constant, as long as the vocabulary, by their numbers; the last stands for characters that are no piece
    row = F.sort_array(F.collect_list(F.struct("k", *fields.values())))
    numbered = table.select("k", *fields.values()).unionByName(none).agg(row.alias("r")).select(F.struct(*(F.col(f"r.{f}").alias(n) for n, f in fields.items())).alias("facts")).scalar()
    dealt = words.repartition("key")
    # most words are shorter than the longest piece: their edges fit into a row of fixed size
    short = F.length("word") <= pieces.longest
    few = short_lattice(dealt.where(short), table, pieces.longest)
    long = dealt.where(~short)
    grouped = long.join(lattice(long.select("key", "word"), table, pieces.longest), "key")

    def ids(path: Column, facts: Column) -> Column:
        return F.flatten(F.transform(path, lambda e: F.when(_number(e) < NO_PIECE, F.array(F.get(facts["ids"], _number(e)))).otherwise(_byte_ids(_number(e) - NO_PIECE, pieces.bytes[0]))))

    def blocks(edges: Column, n: Column, facts: Column) -> Column:
        choice = _bpe_choice(facts) if pieces.bpe else _unigram_choice(facts, pieces.least)
        return viterbi_fold(edges, n, choice, facts["ranks"], pieces.longest)

    def of_few(facts: Column) -> Column:
        if pieces.bpe:
            return ids(let(F.col("tops"), lambda tops: short_fold(tops, facts)), facts)
        edges = F.transform(F.flatten(edges_of(F.col("tops"), facts)), lambda e: e + F.shiftleft(_length(e).cast("long"), 34))
        return ids(let(edges, lambda edges: blocks(edges, F.length("word"), facts)), facts)

    of_long = lambda facts: ids(blocks(F.col("edges"), F.col("n_chars"), facts), facts)
    # the optimizer writes the constant into its single use above the join, so no row carries it
    folded = lambda df, f: df.withColumn("facts", numbered).select(*words.columns, let(F.col("facts"), f).alias("ids"))
    return folded(few, of_few).unionByName(folded(grouped, of_long))


def distinct_fragments(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """word and n of all fragments of all texts. Tasks count within a bounded memory before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows, seen = [], 0, 0

        def summed() -> list[pa.RecordBatch]:
            total = pa.Table.from_batches(counts).group_by("word", use_threads=False).aggregate([("n", "sum")])
            counts.clear()
            return total.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(max_chunksize=1 << 16)

        for block in _blocks(batches, 0):
            found = pieces.cut(block.column(0))[0].dictionary_encode()
            n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
            counts.append(pa.record_batch([found.dictionary, pa.array(n, pa.int64())], ["word", "n"]))
            rows, seen = rows + len(n), seen + block.nbytes
            if rows > COUNTED or seen > COUNTED_CHARS:
                yield from summed()
                rows = seen = 0
        if counts:
            yield from summed()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(known: DataFrame, most: int = FREQUENT, most_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """word, n and ids of the most frequent fragments, as many as both bounds allow; the cut is found in a histogram."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = known.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("word") + 4 * F.size("ids")).alias("size")).collect()
    cut, rows, size = None, 0, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        rows, size = rows + r["rows"], size + r["size"]
        if rows > most or size > most_bytes:
            break
        cut = r["level"]
    return known.where(F.lit(False) if cut is None else level >= cut).select("word", "n", "ids")


def _packed(columns: dict[str, pa.Array]) -> bytes:
    """Columns of equal length as one compressed value."""
    batch, sink = pa.record_batch(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(value: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(value.as_buffer()) as found:
        return found.read_next_batch()


def shared_ids(spark: SparkSession, words: DataFrame, pieces: Pieces) -> Broadcast:
    """(words, how many ids each has, all ids) of a bounded table (see frequent()) for all tasks; a word's number is its place, frequent ones first."""
    rows = words.toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    word, ids = (pa.concat_arrays(rows[c].chunks) if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("word", "ids"))
    return spark.sparkContext.broadcast((word, pc.list_value_length(ids).to_numpy(), ids.flatten().to_numpy().astype(pieces.id_type)))


def encode_known(docs: DataFrame, pieces: Pieces, shared: Broadcast) -> DataFrame:
    """Blocks of texts: block (its number), texts (doc_id, n_words, size in fragments and SHA-256 of each), numbers (of all their fragments in order, a byte a column), words (the block's other fragments, whose numbers go on after the shared ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        for block in _blocks(batches, 2):
            fragments, sizes, n_words = pieces.cut(block.column(2))
            found = fragments.dictionary_encode()
            number = pc.fill_null(pc.index_in(found.dictionary, value_set=known), -1).to_numpy().astype(np.int32)
            other = number < 0
            number[other] = len(known) + np.arange(other.sum())
            # most numbers are small, and bytes of one place are alike
            places = number[found.indices.to_numpy()].astype("<i4").view(np.uint8).reshape(-1, 4).T
            digests = [hashlib.sha256((t or "").encode()).digest() for t in block.column(2).to_pylist()]
            texts = {"doc_id": block.column(1), "n_words": pa.array(n_words, pa.int64()), "size": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary(32))}
            row = _packed(texts), _packed({str(i): pa.array(np.ascontiguousarray(p)) for i, p in enumerate(places)}), _packed({"word": found.dictionary.filter(pa.array(other))})
            yield pa.record_batch([block.column(0)[:1], *(pa.array([x], pa.binary()) for x in row)], ["block", "texts", "numbers", "words"])

    rows = docs.select(F.monotonically_increasing_id().alias("block"), docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "block long, texts binary, numbers binary, words binary")


def _missing(parts: DataFrame) -> DataFrame:
    """block, k and word of all blocks' other fragments. A function of whole rows: with fewer columns the shuffle below would be another one, and texts encoded twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block"), batch.column("words")):
                words = _opened(packed).column("word")
                yield pa.record_batch([pa.repeat(block, len(words)), pa.array(np.arange(len(words)), pa.int32()), words], ["block", "k", "word"])

    return parts.mapInArrow(run, "block long, k int, word string")


def written_by(pieces: Pieces) -> list[bytes]:
    """What each id writes: its piece, or its byte."""
    out = [b""] * (max(i for _, i, _ in pieces.rows) + 257)
    for p, i, _ in pieces.rows:
        out[i] = p.encode()
    for k, b in enumerate(pieces.bytes):
        out[b] = bytes([k])
    return out


def _finish(parts: DataFrame, fills: DataFrame, pieces: Pieces, shared: Broadcast) -> DataFrame:
    """The texts of all blocks as whole ids, and those ids as texts; fills has block, k and ids of their other fragments."""
    written = pa.array(written_by(pieces), pa.binary())

    def run(block: pa.Table, fill: pa.Table) -> pa.Table:
        texts, numbers = (_opened(block[c][0]) for c in ("texts", "numbers"))
        numbers = np.stack([c.to_numpy() for c in numbers.columns], 1).view("<i4").ravel()
        _, n_known, known = shared.value
        own = fill.sort_by("k")["ids"].combine_chunks()
        sizes = np.append(n_known, pc.list_value_length(own).to_numpy()).astype(np.int64)
        values = np.append(known, own.flatten().to_numpy().astype(known.dtype))
        first, n = (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]
        ends = np.append(0, np.cumsum(n))
        ids = values[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])].astype(np.int32)
        bounds = ends[np.append(0, np.cumsum(texts.column("size").to_numpy()))]
        # each id's bytes one after another are the texts
        taken = written.take(pa.array(ids))
        at = np.frombuffer(taken.buffers()[1], np.int32)[bounds].tolist()
        data = (taken.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        # without the space that encoding puts in front
        decoded = [data[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(at, at[1:])]
        trips = [hashlib.sha256(t.encode()).digest() == d for t, d in zip(decoded, texts.column("digest").to_pylist())]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
        columns = [texts.column("doc_id"), texts.column("n_words"), pa.array(np.diff(bounds), pa.int64()), lists, pa.array(decoded, pa.string()), pa.array(trips, pa.bool_())]
        return pa.table(columns, ["doc_id", "n_words", "n_pieces", "ids", "decoded", "round_trip"])

    ddl = "doc_id long, n_words long, n_pieces long, ids array<int>, decoded string, round_trip boolean"
    return parts.groupBy("block").cogroup(fills.groupBy("block")).applyInArrow(run, ddl)


def known_fragments(spark: SparkSession, docs: DataFrame, pieces: Pieces) -> DataFrame:
    """word, n and ids of all distinct fragments of the texts, stored."""
    # stored, so that the fragments are found once and keep their numbers
    words = materialize(spark, distinct_fragments(docs, pieces).withColumn("key", F.monotonically_increasing_id()), "words")
    return materialize(spark, encode_words(spark, words, pieces).select("word", "n", "ids"), "word-ids")


def encode_texts(spark: SparkSession, docs: DataFrame, pieces: Pieces, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_words, n_pieces, ids of the whole text in order, decoded (those ids as text), round_trip: whether decoded is the text."""
    known = known_fragments(spark, docs, pieces)
    shared = shared_ids(spark, frequent(known, most), pieces)
    # the texts' numbers lie on disk once: in this shuffle, which both ways below read
    parts = encode_known(docs, pieces, shared).repartition("block")
    fills = _missing(parts).join(known.select("word", "ids"), "word").select("block", "k", "ids")
    return _finish(parts, fills, pieces, shared)
