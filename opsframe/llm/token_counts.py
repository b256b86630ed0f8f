"""Token counts by a counting transducer, chunk by chunk.

The BPE model is compiled, one transition a word as texts ask for it, into a
deterministic transducer over characters; what is not compiled is worked out by the
same rule each time. A transition carries the change in the
number of emitted tokens. This is sound because every boundary of a finished BPE
segmentation is one that no merge crossed: the segmentation of a prefix p is that
of p without its last token t, followed by t, and t is the last token exactly if
it is a piece that encodes to itself and the pair (last token before it, t)
encodes to itself. A state therefore has to keep only the last characters, as
many as the longest piece has, and the last token and the count at each of them.

Between words the transducer resets, so a chunk's state map is known by three
things: the fragment before its first boundary, the tokens of its whole words and
the fragment after its last boundary; a chunk without a boundary is one fragment.
Composing two maps joins the fragments at the seam. Composition is associative, so
the maps of a document's chunks, each counted by itself, are composed in parallel:
neighbours in blocks, then blocks of blocks.

Defined cases: null text counts as empty: 0 bytes and 0 tokens; repeated rows and
repeated or null ids each get their own row; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 1 << 16
BLOCK = 32
#: No string is longer than this.
MOST_CHARS = 1 << 31
#: Entries of each of the three memories for words, and bounds of compiled transitions; what goes beyond is compiled again.
#: An entry has 64 characters at most, so it has at most 440 bytes, and some 190 for usual words.
MEMO, LONGEST = 450_000, 64
MEMO_BYTES = MEMO * 440
MOVES = 200_000


class PieceModel:
    """Pieces and merge order of a BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != spec.BPE or not spec.byte_fallback or norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback, no normalization and a leading space")
        self.score = {p.piece.replace("▁", " "): p.score for p in model.pieces if p.type == p.NORMAL}
        if any(re.search("[^ ] ", p) for p in self.score):
            raise ValueError("a piece crosses the start of a word")
        self.longest = max(map(len, self.score), default=1)
        #: No piece holds other neighbours than these, so a text can be cut between all others.
        self.neighbours = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.alone = {"\n"} - {c for p in self.score if len(p) > 1 for c in p}

    def fragments(self, text: str) -> list[str]:
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.neighbours]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if cuts else [text]

    def merge(self, text: str) -> list[tuple[float, list[str]]]:
        """Plain BPE, the best scored pair first, the leftmost of equals: (score of the next merge, symbols) for each stage."""
        symbols, stages = list(text), []
        while True:
            pairs = [(-self.score[s], i) for i in range(len(symbols) - 1) if (s := symbols[i] + symbols[i + 1]) in self.score]
            if not pairs:
                return [*stages, (float("-inf"), symbols)]
            less, i = min(pairs)
            stages.append((-less, symbols))
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


class CountingTransducer:
    """States are the suffix, the last token at each of its cuts and the counts between cuts; outputs are count changes."""

    def __init__(self, model: PieceModel):
        self.model, self.solid = model, {}
        #: left token to right token to whether they fit; by number (suffix, last token at each of its cuts, count changes between cuts)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.states: list[tuple] = [("", ("",), ())]
        self.number = {self.states[0]: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}

    def trace(self, piece: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether the piece encodes to itself, and its first and last symbol at each stage on the way."""
        if (known := self.solid.get(piece)) is None:
            stages = self.model.merge(piece)
            known = self.solid[piece] = len(stages[-1][1]) == 1, [(score, s[0], s[-1]) for score, s in stages]
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether no merge crosses from left to right while both are built: the better next merge goes first, the left of equals."""
        if left == "":
            return True
        a, b, i, j, score = self.trace(left)[1], self.trace(right)[1], 0, 0, self.model.score
        while True:
            next_a, next_b = a[i][0], b[j][0]
            across = score.get(a[i][2] + b[j][1])
            if across is not None and across > next_a and across >= next_b:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if next_a >= next_b and i < len(a) - 1:
                i += 1
            else:
                j += 1

    def rest(self, state: int, word: str, at: int) -> int:
        """Tokens that word[at:] adds in a state; the first step becomes a transition."""
        suffix, lasts, changes = self.states[state]
        text, score, longest, begin = suffix + word[at:], self.model.score, self.model.longest, len(suffix) + 1
        lasts, counts = list(lasts), [0]
        for change in reversed(changes):
            counts.append(counts[-1] - change)
        counts.reverse()
        for n in range(begin, len(text) + 1):
            for cut in range(max(0, n - longest), n):
                token = text[cut:n]
                if cut == n - 1 or token in score and self.trace(token)[0]:
                    left = lasts[cut]
                    known = self.pairs.get(left)
                    if known is None:
                        known = self.pairs[left] = {}
                    if (fit := known.get(token)) is None:
                        fit = known[token] = self.fits(left, token)
                    if fit:
                        break
            lasts.append(token)
            counts.append(counts[cut] + (1 if token in score else len(token.encode("utf-8", "surrogatepass"))))
            if n == begin and len(self.moves) < MOVES:
                low = max(0, n - longest)
                key = (text[low:n], tuple(lasts[low:]), tuple(counts[i + 1] - counts[i] for i in range(low, n)))
                found = self.number.setdefault(key, len(self.states))
                if found == len(self.states):
                    self.states.append(key)
                self.moves[state, word[at]] = found, counts[-1]
        if len(self.pairs) > MOVES // 8:
            self.pairs.clear()
        return counts[-1]

    def count(self, word: str) -> int:
        state = total = 0
        moves = self.moves
        for at, c in enumerate(word):
            if (move := moves.get((state, c))) is None:
                return total + self.rest(state, word, at)
            state = move[0]
            total += move[1]
        return total


class _Fragments(dict):
    """Fragment to its number of tokens."""

    def __init__(self, machine: CountingTransducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, fragment: str) -> int:
        n = self.machine.count(fragment)
        if len(fragment) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[fragment] = n
        return n


class _Stretches(dict):
    """Stretch between blanks, with or without the blank before it, to its number of tokens."""

    def __init__(self, fragments: _Fragments, prefix: str):
        super().__init__()
        self.known, self.prefix, self.cut = fragments, prefix, fragments.machine.model.fragments

    def __missing__(self, stretch: str) -> int:
        text = self.prefix + stretch
        n = sum(map(self.known.__getitem__, self.cut(text))) if text else 0
        if len(stretch) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[stretch] = n
        return n


class ChunkCounter:
    """State maps of chunks: (head, tokens of whole words, tail), head None if there's no boundary."""

    def __init__(self, model: PieceModel):
        self.model, self.machine = model, CountingTransducer(model)
        fragments = _Fragments(self.machine)
        self.spaced, self.bare = _Stretches(fragments, " "), _Stretches(fragments, "")
        alone = "".join(map(re.escape, sorted(model.alone)))
        self.words = re.compile(rf"[{alone}]| +[^ {alone}]*|[^ {alone}]+" if alone else r" +[^ ]*|[^ ]+")
        self.edge = re.compile(rf"[{alone}]|(?<=[^ ])(?= )" if alone else r"(?<=[^ ])(?= )")

    def inner(self, text: str) -> int:
        """Tokens of a text that starts and ends at boundaries."""
        if "\n" not in self.model.alone:
            return sum(map(self.bare.__getitem__, self.words.findall(text)))
        total = text.count("\n") * self.bare["\n"]
        for line in text.split("\n"):
            if line:
                parts = line.split(" ")
                if "" in parts:
                    total += sum(map(self.bare.__getitem__, self.words.findall(line)))
                    continue
                total += self.bare[parts[0]]
                total += sum(map(self.spaced.__getitem__, parts[1:]))
        return total

    def map(self, text: str, first: bool, final: bool) -> tuple[str | None, int, str]:
        """The state map of one chunk; the ends of the document are boundaries."""
        a, b = 0, len(text)
        if not first:
            if (m := self.edge.search(text)) is None:
                return (None, 0, text) if not final else (text, 0, "")
            a = m.start()
        if not final:
            tail = max(text.rfind("\n") + 1 if "\n" in self.model.alone else 0, _last_word(text))
            if tail <= a:
                return (text, 0, "") if first and not text else (text[:a] if not first else "", self.inner(text[a:tail]) if tail > a else 0, text[max(a, tail) :])
            b = tail
        return text[:a], self.inner(text[a:b]), text[b:]

    def compose(self, left: tuple[str | None, int, str], right: tuple[str | None, int, str]) -> tuple[str | None, int, str]:
        """The state map of two neighbouring runs of chunks. Associative: what the seam joins is counted once both its boundaries are known."""
        if right[0] is None:
            return left[0], left[1], left[2] + right[2]
        if left[0] is None:
            return left[2] + right[0], right[1], right[2]
        return left[0], left[1] + self.inner(left[2] + right[0]) + right[1], right[2]

    def scan(self, maps: list[tuple[str | None, int, str]]) -> tuple[str | None, int, str]:
        """All maps composed, neighbours first, so that a word over many chunks is joined in few steps."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]


@lru_cache(maxsize=1)
def chunk_counter(model_path: str) -> ChunkCounter:
    """One transducer for all tasks that a Python worker runs."""
    return ChunkCounter(PieceModel(model_path))


def _last_word(text: str) -> int:
    """Where the last run of spaces that follows a letter starts, or 0."""
    at = text.rfind(" ")
    while at > 0 and text[at - 1] == " ":
        at -= 1
    return max(at, 0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema.names)


def _spaced(text: str | None) -> str:
    return " " + text.replace("▁", " ") if text else ""


def count_tokens(docs: DataFrame, model_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row for each row of docs.

    Texts of one chunk are counted where they are read, without a shuffle. The chunks
    of longer ones are rows, dealt over all tasks; their maps are composed in blocks of
    BLOCK neighbours, then blocks of blocks, as many times as the longest string can need.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") >= chunk_chars, F.lit(False))
    ddl = "doc_id long, n_bytes long, n_tokens long"
    counts = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = chunk_counter(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            tokens = [counter.map(_spaced(t), True, True)[1] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], counts.names)

    pieces = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("n_bytes", pa.int64()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                uid, doc, text = (batch.column(c)[i].as_py() for c in range(3))
                size, text = len(text.encode("utf-8", "surrogatepass")), _spaced(text)
                for at in range(0, len(text), chunk_chars):
                    last = at + chunk_chars >= len(text)
                    yield _batch([(uid, doc, at // chunk_chars, last, size if at == 0 else 0, text[at : at + chunk_chars])], pieces)

    maps = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("n_bytes", pa.int64()), ("head", pa.string()), ("n", pa.int64()), ("tail", pa.string())])
    maps_ddl = "uid long, doc_id long, chunk long, n_bytes long, head string, n long, tail string"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = chunk_counter(model_path)
        for batch in batches:
            yield _batch([(r["uid"], r["doc_id"], r["chunk"], r["n_bytes"], *counter.map(r["text"], r["chunk"] == 0, r["last"])) for r in batch.to_pylist()], maps)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = chunk_counter(model_path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                block = sorted(r["maps"], key=lambda m: m["chunk"])
                out.append((r["uid"], r["doc_id"], r["block"], r["n_bytes"], *counter.scan([(m["head"], m["n"], m["tail"]) for m in block])))
            yield _batch(out, maps)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = chunk_counter(model_path)
        for batch in batches:
            # the ends of a text are boundaries
            yield _batch([(r["doc_id"], r["n_bytes"], r["n"] + counter.inner(r["head"] or "") + counter.inner(r["tail"])) for r in batch.to_pylist()], counts)

    numbered = rows.where(is_long).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    chunks = numbered.mapInArrow(cut, "uid long, doc_id long, chunk long, last boolean, n_bytes long, text string")
    found, reach = chunks.repartition("uid", "chunk").mapInArrow(count, maps_ddl), chunk_chars
    while reach < MOST_CHARS:
        blocks = found.groupBy("uid", "doc_id", F.floor(F.col("chunk") / BLOCK).alias("block")).agg(F.sum("n_bytes").alias("n_bytes"), F.collect_list(F.struct("chunk", "head", "n", "tail")).alias("maps"))
        found, reach = blocks.mapInArrow(compose, maps_ddl), reach * BLOCK
    return rows.where(~is_long).mapInArrow(short, ddl).unionByName(found.mapInArrow(close, ddl))
