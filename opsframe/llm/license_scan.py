"""Fuzzy short-notice search over whole texts.

Each notice of length m may differ in k = m // 10 edits. Split into k + 1 parts,
at least one part stands unchanged in any such copy (pigeonhole), so exact
searches for the parts find every candidate; bounded-error matching of the
regex library then verifies the stretch around each and reports its edits.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Phrases
match on word boundaries of the text whose words are joined by single spaces.

Defined cases: null text counts as empty; a text without words has no place,
null first/last word, empty labels and score 0; repeated rows each get a row;
all columns but doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of the method, (label, phrase as words).
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("as-is", "the software is provided as is without warranty of any kind"),
    ("boost", "boost software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc0", "creative commons zero public domain dedication"),
    ("epl", "eclipse public license"),
    ("gpl", "licensed under the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
EDITS_PER = 10

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
)
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
_ARROW = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def seeds(phrase: str, k: int) -> list[tuple[int, bytes]]:
    """k + 1 parts of near equal length with their offsets."""
    cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
    return [(a, phrase[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


def compiled(notices: list[tuple[str, str]]) -> list[tuple]:
    out = []
    for label, phrase in notices:
        k = len(phrase) // EDITS_PER
        out.append((label, phrase, k, seeds(phrase, k), regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(phrase, literal_spaces=True)}){{e<={k}}}(?![^ ])")))
    return out


def _places(hay: bytes, needle: bytes) -> Iterator[int]:
    at = hay.find(needle)
    while at >= 0:
        yield at
        at = hay.find(needle, at + 1)


def scan_text(text: str | None, notices: list[tuple]) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    norm = b" ".join(words)
    framed = b" " + norm + b" "
    starts: list[int] = []
    base: set[str] = set()
    for phrase, label in BASE.items():
        done = number = 0
        for at in _places(framed, f" {phrase} ".encode()):
            number += framed.count(b" ", done, at)
            done = at
            starts.append(number)
            base.add(label)
    spans: list[tuple[str, int, int, int]] = []
    best = 1.0 if starts else 0.0
    for label, phrase, k, parts, pattern in notices:
        windows = sorted((max(0, at - offset - k - 1), at - offset + len(phrase) + k + 1) for offset, part in parts for at in _places(norm, part))
        merged: list[list[int]] = []
        for a, b in windows:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        done = number = 0
        for a, b in merged:
            # whole words, plus what a window of bytes may cut short where edits are letters of several bytes
            a = norm.rfind(b" ", 0, max(0, a - 3 * k)) + 1
            b = norm.find(b" ", b + 3 * k)
            piece = norm[a : b if b >= 0 else len(norm)].decode("utf-8", "surrogatepass")
            number += norm.count(b" ", done, a)
            done = a
            for m in pattern.finditer(piece):
                edits = sum(m.fuzzy_counts)
                first = number + piece.count(" ", 0, m.start())
                spans.append((label, first, first + m.group().strip().count(" "), edits))
                best = max(best, 1 - edits / len(phrase))
    # of notices that overlap, those with more edits than another are that other one, misread
    spans = sorted({s for s in spans if not any(o[3] < s[3] and o[1] <= s[2] and s[1] <= o[2] for o in spans)}, key=lambda s: (s[1], s[2], s[0], s[3]))
    labels = base | {s[0] for s in spans}
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        best,
        [dict(zip(("label", "first_word", "last_word", "edits"), s)) for s in spans],
    )


def scan_notices(docs: DataFrame, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id and what SCHEMA lists, one row a document."""
    rules = NOTICES if notices is None else notices

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = compiled(rules)
        for batch in batches:
            rows = [scan_text(t, ready) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["doc_id", *_ARROW.names])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(scan, f"doc_id long, {SCHEMA}")
