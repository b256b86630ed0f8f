"""Prices, similarity scores and match rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe.functions.text import SIZE_SUFFIXES, bigrams, match_tokens, norm_text


def clean_price(c: Column) -> Column:
    """Digits and dots as a number, null if there are none."""
    return F.nullif(F.regexp_replace(c, r"[^\d.]", ""), F.lit("")).try_cast("double")


def price_digits(c: Column) -> Column:
    """All digits as a number; a decimal point is dropped, so 49.50 is 4950."""
    return F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit("")).try_cast("bigint")


def format_inr(n: Column) -> Column:
    """Indian digit grouping with the rupee sign: 1234567 is ₹12,34,567."""
    s = n.cast("bigint").cast("string")
    head = F.regexp_replace(F.substr(s, F.lit(1), F.length(s) - 3), r"(\d)(?=(\d{2})+$)", "$1,")
    return F.concat(F.lit("₹"), F.when(F.length(s) > 3, F.concat(head, F.lit(","), F.right(s, F.lit(3)))).otherwise(s))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, clamp: bool = True) -> Column:
    """Cosine; clamped to [0, 1] and rounded half-even to 4 places if asked for."""
    raw = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.bround(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)), 4) if clamp else raw


def phash_score(distance: Column) -> Column:
    # fixed values: greatest distance and points
    steps = ((5, 80), (10, 68), (15, 55), (20, 35), (25, 20), (30, 10))
    out = F.when(distance <= steps[0][0], float(steps[0][1]))
    for bound, score in steps[1:]:
        out = out.when(distance <= bound, float(score))
    return out.otherwise(0.0)


def image_url_equal(a: Column, b: Column) -> Column:
    """Same image up to query and size suffixes, or one long URL within the other."""

    def bare(c: Column) -> Column:
        c = F.substring_index(c, "?", 1)
        for suffix in SIZE_SUFFIXES:
            c = F.substring_index(c, suffix, 1)
        return c

    def same(u: Column) -> Column:
        x, y = u["x"], u["y"]
        return F.coalesce((x == y) | ((F.length(x) > 30) & F.contains(y, x)) | ((F.length(y) > 30) & F.contains(x, y)), F.lit(False))

    return let(F.struct(bare(a).alias("x"), bare(b).alias("y")), same)


def let(value: Column, f) -> Column:
    """f(value) with value computed once a row: a lambda variable, where a column would be written out at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text_evidence(title: Column, name: Column, price_a: Column, price_b: Column) -> Column:
    """struct<text_score, overlap, longest, has_text> of two titles and prices; tokens and pairs are worked out once."""

    def scored(x: Column) -> Column:
        t, n, bt, bn = (x[c] for c in ("t", "n", "bt", "bn"))
        # fixed values: the weights of the text score
        shorter, longer = F.when(F.size(t) <= F.size(n), t).otherwise(n), F.when(F.size(t) <= F.size(n), n).otherwise(t)
        least = F.least(F.size(t), F.size(n))
        partial = F.when(least > 0, let(longer, lambda lo: F.size(F.filter(shorter, lambda w: F.array_contains(lo, w)))) / least).otherwise(0.0)
        bigram = F.when((F.size(bt) > 0) & (F.size(bn) > 0), F.size(F.array_intersect(bt, bn)) / F.size(F.array_union(bt, bn))).otherwise(0.0)
        jaccard = x["overlap"] / F.size(F.array_union(t, n))
        pa, pb = x["pa"], x["pb"]
        price = F.when((pa > 0) & (pb > 0) & (F.least(pa, pb) / F.greatest(pa, pb) >= 0.7), F.least(3 * F.least(pa, pb) / F.greatest(pa, pb), F.lit(2.0))).otherwise(0.0)
        first = F.when(F.get(t, F.lit(0)) == F.get(n, F.lit(0)), 1.5).otherwise(0.0)
        some = (F.size(t) > 0) & (F.size(n) > 0)
        total = F.when(some, 7.5 * partial + 5 * bigram + 4 * jaccard + first + price).otherwise(0.0)
        return F.struct(total.alias("text_score"), x["overlap"].alias("overlap"), F.greatest(F.size(t), F.size(n)).alias("longest"), some.alias("has_text"))

    def pairs(x: Column) -> Column:
        own = F.struct(x["t"].alias("t"), x["n"].alias("n"), bigrams(x["t"]).alias("bt"), bigrams(x["n"]).alias("bn"), F.size(F.array_intersect(x["t"], x["n"])).alias("overlap"), x["pa"].alias("pa"), x["pb"].alias("pb"))
        return let(own, scored)

    return let(F.struct(match_tokens(title).alias("t"), match_tokens(name).alias("n"), clean_price(price_a).alias("pa"), clean_price(price_b).alias("pb")), pairs)


# The plain scorer's points of the same image and of all words in common, and the least score that counts.
SAME_IMAGE, ALL_WORDS, LEAST_OVERLAP = 100.0, 50.0, 10.0


def overlap_score(image_equal: Column, title: Column, name: Column) -> Column:
    """The plain scorer: points of the same image, and of the share of words that both titles have; 0 of a title without words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    most = lambda x: F.greatest(F.size(x["a"]), F.size(x["b"]))
    share = lambda x: F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), ALL_WORDS * F.size(F.array_intersect(x["a"], x["b"])) / most(x)).otherwise(0.0)
    return F.when(image_equal, SAME_IMAGE).otherwise(0.0) + let(F.struct(words(title).alias("a"), words(name).alias("b")), share)


def match_score(image_equal: Column, hash_score: Column, text: Column) -> Column:
    """100 for the same image, else hash and text score, less 15 % where texts are unrelated; 100 at most. `text` is a text_evidence()."""
    total = hash_score + text["text_score"]
    cut = text["has_text"] & (text["overlap"] <= 1) & (text["longest"] > 2)
    return F.when(image_equal, 100.0).otherwise(F.least(F.when(cut, total * 0.85).otherwise(total), F.lit(100.0)))


def verified_score(base: Column, d: Column, c: Column) -> Column:
    return F.greatest(base, d * 80, c * 75)


def match_gate(is_reverse: Column, d: Column, c: Column, reverse=(0.45, 0.55), text=(0.60, 0.65)) -> Column:
    """With reverse-image evidence only two low similarities fail; by text alone both have to be high."""
    d, c = F.coalesce(d, F.lit(0.0)), F.coalesce(c, F.lit(0.0))
    return F.when(is_reverse, ~((d < reverse[0]) & (c < reverse[1]))).otherwise((d >= text[0]) & (c >= text[1]))


def match_tag(score: Column) -> Column:
    return F.when(score >= 85, "Exact Match").when(score >= 70, "Match").when(score >= 50, "Similar").when(score.isNotNull(), "Almost Similar")


def relevance(title: Column, name: Column, views: Column) -> Column:
    """50 for the whole name, 30 by the share of its words found, up to 20 for views."""
    texts = F.struct(norm_text(title).alias("t"), norm_text(name).alias("n"))

    def points(x: Column) -> Column:
        words = F.split(x["n"], " ")
        found = let(words, lambda ws: F.size(F.filter(ws, lambda w: (F.length(w) > 2) & F.contains(x["t"], w))) / F.size(ws))
        return F.when(F.contains(x["t"], x["n"]), 50.0).otherwise(0.0) + 30.0 * found

    # let: written out, the texts would be normalised once more for each word
    return let(texts, points) + F.when(views > 0, F.least(5 * F.log10(views.cast("double")), F.lit(20.0))).otherwise(0.0)


def is_short(duration: Column, strict: bool = True) -> Column:
    """Up to 60 s: 0:SS, or 0:0:SS where not strict; an unknown duration is short."""
    p = F.split(duration, ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    two = (F.size(p) == 2) & (n(0) == 0) & (n(1) <= 60)
    three = (F.size(p) == 3) & (n(0) == 0) & (n(1) == 0) & (n(2) <= 60)
    return F.when(duration.isNull() | (duration == ""), True).when(F.size(p) == 2, two).when(F.size(p) == 3, F.lit(False) if strict else three).otherwise(not strict)


def iso_duration(c: Column) -> Column:
    """PT1H2M3S to 1:02:03, PT5S to 0:05."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?", i), F.lit(""))
    padded = lambda x: F.lpad(x, F.greatest(F.length(x), F.lit(2)), F.lit("0"))
    minutes = F.when(part(2).isNull(), "0").when(part(1).isNotNull(), padded(part(2))).otherwise(part(2))
    text = F.concat(F.coalesce(F.concat(part(1), F.lit(":")), F.lit("")), minutes, F.lit(":"), padded(F.coalesce(part(3), F.lit("0"))))
    return F.when(c.rlike("PT"), text).otherwise("")


def view_count(c: Column) -> Column:
    """`1,234 views` to 1234."""
    return F.regexp_replace(F.regexp_extract(c, r"([\d,]+)\s*views?", 1), ",", "").try_cast("bigint")
