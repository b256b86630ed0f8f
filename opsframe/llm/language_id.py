"""Language identification with bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of its most frequent n-grams. The filters lie
side by side: slot i of the table is a bit mask of the languages whose filter has
bit i, so the AND of an n-gram's slots gives all languages that contain it in one
lookup. A text's hits per language are corrected for false positives with the
filter's own fill rate; the language with the most corrected hits is predicted.

Training takes at most MAX_TRAIN_DOCS labelled texts a language in expectation
(picked by a hash of the text, equal ones once, whole); the model is the TOP_GRAMS
most frequent n-grams of each, which is what the driver holds. Prediction reads
whole texts.

Defined cases: text null or without a letter: `und`, score 0; a text of which no
n-gram is known gets the language with the most training rows, score 0; without
any training row every prediction is `und`; ties go to the alphabetically first
language; rows of null lang are not learned from; repeated rows each get a row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.llm.common import sliced

N = 4
HASHES = 2
SLOT_BITS = 18
TOP_GRAMS = 6000
MAX_TRAIN_DOCS = 4000
SLAB = 1 << 18
PICKS = 1 << 62


@dataclass
class Model:
    languages: list[str]
    prior: int
    table: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point to its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def gram_hashes(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of N folded code points, and whether it counts: it has no two breaks in a row."""
    x = folded.astype(np.uint64)
    n = max(0, len(x) - N + 1)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(N):
        h = (h ^ x[i : i + n]) * np.uint64(0x100000001B3)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    pair = (folded[1:] == 0) & (folded[:-1] == 0)
    ok = np.ones(n, bool)
    for i in range(N - 1):
        ok &= ~pair[i : i + n]
    return h, ok


def slots(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(SLOT_BITS * i)) & mask).astype(np.int64) for i in range(HASHES)]


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Folded code points of slabs of texts and the document number of each; long texts in overlapping slabs."""
    gap = "\0\0"
    slab: list[str] = [gap]
    owners: list[int] = [0]
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(slab).encode("utf-32-le", "surrogatepass"), np.uint32)
        return _folding()[points], np.repeat(np.array(owners), [len(s) for s in slab])

    for i, text in enumerate(texts):
        for at in range(0, len(text), SLAB):
            part = text[at : at + SLAB + N - 1]
            # the pad stands for the break at a text's ends, the gap keeps n-grams from spanning texts
            slab += [("\0" if at == 0 else "") + part + ("\0" if at + SLAB >= len(text) else ""), gap]
            owners += [i, i]
            size += len(part)
            if size >= SLAB:
                yield flush()
                slab, owners, size = [gap], [i], 0
    if size:
        yield flush()


def predict_texts(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    n_lang = len(model.languages)
    hits, total, letters = np.zeros((len(texts), n_lang)), np.zeros(len(texts)), np.zeros(len(texts))
    for folded, owner in _pieces([t or "" for t in texts]):
        letters += np.bincount(owner, folded != 0, len(texts))
        if not n_lang:
            continue
        h, ok = gram_hashes(folded)
        at, h = owner[: len(ok)][ok], h[ok]
        total += np.bincount(at, minlength=len(texts))
        for word in range(model.table.shape[1]):
            mask = model.table[:, word]
            found = np.bitwise_and.reduce([mask[s] for s in slots(h)])
            for bit in range(min(64, n_lang - 64 * word)):
                hits[:, 64 * word + bit] += np.bincount(at, ((found >> np.uint64(bit)) & np.uint64(1)).astype(np.float64), len(texts))
    if not n_lang:
        return ["und"] * len(texts), [0.0] * len(texts)
    true = np.maximum(0, hits - total[:, None] * model.false_rate) / (1 - model.false_rate)
    best = true.argmax(1)
    top, mass = true.max(1), true.sum(1)
    best[top == 0] = model.prior
    score = np.where(top > 0, top / np.maximum(mass, 1e-300), 0.0)
    return (
        ["und" if not letters[i] else model.languages[best[i]] for i in range(len(texts))],
        [0.0 if not letters[i] else float(min(1.0, score[i])) for i in range(len(texts))],
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: those whose crc32(doc_id as text) mod 5 is not 0."""
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def pick_below(count: int, max_docs: int) -> int:
    """Texts whose hash, evenly spread below PICKS, is under this are learned from: max_docs of count in expectation."""
    return min(PICKS, max_docs * PICKS // count)


def fit(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, top_grams: int = TOP_GRAMS) -> Model:
    """Learn from training_rows(docs) alone."""
    rows = training_rows(docs).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(PICKS)).alias("pick"))
    sizes = rows.groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in sizes.collect()}  # one row a language
    if not counts:
        return Model([], 0, np.zeros((1, 1), np.uint64), np.zeros(0))
    languages = sorted(counts)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(pick_below(counts[lang], max_docs)))])
    # copies of a text are all picked or none, so they count once
    sample = rows.where(F.col("pick") < share[F.col("lang")]).dropDuplicates(["lang", "pick"]).select("lang", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for folded, _ in _pieces([t for t, own in zip(texts, langs) if own == lang]):
                    h, ok = gram_hashes(folded)
                    key, n = np.unique(h[ok], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = sample.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    table = np.zeros((1 << SLOT_BITS, (len(languages) + 63) // 64), np.uint64)
    filled = np.zeros(len(languages))
    kept = ranked.where(F.col("r") <= top_grams).select("lang", "gram").toPandas()  # at most top_grams a language
    for i, lang in enumerate(languages):
        h = kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        word, bit = divmod(i, 64)
        for s in slots(h):
            table[s, word] |= np.uint64(1 << bit)
        filled[i] = np.count_nonzero(table[:, word] & np.uint64(1 << bit)) / len(table)
    return Model(languages, max(range(len(languages)), key=lambda i: (counts[languages[i]], -i)), table, filled**HASHES)


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lang, score = predict_texts(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all their columns, whose language can be told. No shuffle.

    Rows go that have no letter, or no n-gram of any language beyond what false
    positives explain; without any language learned, rows with a letter stay.
    """
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, model = batch.column(at).to_pylist(), shared.value
            if model.languages:
                lang, score = predict_texts(texts, model)
                told = [x != "und" and s > 0 for x, s in zip(lang, score)]
            else:
                told = [any(map(str.isalpha, t or "")) for t in texts]
            yield batch.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0
