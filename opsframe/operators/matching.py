"""Marketplace price matching: candidates, scores, gates, best offers, one wide row a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.scores import LEAST_OVERLAP, hamming64, image_url_equal, let, match_gate, match_score, match_tag, overlap_score, phash_score, text_evidence, verified_score

PLATFORMS = ("amazon", "flipkart", "meesho")
#: Points of a reverse-image hit, and the score from which a match is reliable.
REVERSE_BONUS, RELIABLE = 30.0, 35.0


def score_candidates(candidates: DataFrame, scale: float = 1.0) -> DataFrame:
    """Candidates with text_score, score, verified, passes and reliable. `scale` stretches hash distances of short hashes."""
    same = image_url_equal(F.col("image_url"), F.col("cand_image"))
    by_hash = phash_score(hamming64(F.col("phash"), F.col("cand_phash")) * scale)
    reverse = F.col("source") == "revimg"

    def scored(text: Column) -> Column:
        score = match_score(same, by_hash, text) + F.when(reverse, REVERSE_BONUS).otherwise(0.0)
        return F.struct(text["text_score"].alias("text_score"), score.alias("score"))

    # one struct, so that no use of a score repeats the work of the texts
    found = candidates.withColumn("__s", let(text_evidence(F.col("title"), F.col("cand_title"), F.col("price"), F.col("cand_price")), scored))
    found = found.select(*candidates.columns, "__s.text_score", "__s.score")
    verified = verified_score(F.col("score"), F.col("dinov2_sim"), F.col("clip_sim"))
    return found.withColumns({"verified": verified, "passes": match_gate(reverse, F.col("dinov2_sim"), F.col("clip_sim")), "reliable": verified >= RELIABLE})


def best_candidate(scored: DataFrame) -> DataFrame:
    """The candidate of the best verified score above 0 for each product and platform; ties to the smaller cand_key."""
    rest = [c for c in scored.columns if c not in ("product_key", "platform")]
    order = F.struct(F.round("verified", 9), -F.col("cand_key"))
    best = scored.groupBy("product_key", "platform").agg(F.max_by(F.struct(*rest), order).alias("best"))
    return best.select("product_key", "platform", "best.*").where("verified > 0")


def best_overlap(offers: DataFrame, order: str) -> DataFrame:
    """product_key, offer, match_score, image_match: the offer of the greatest plain score, the earliest of equal ones.

    Offers (product_key, title, image_url, cand_title, cand_image, more columns) come in `order`. Where no score reaches 10,
    the first offer stands for the product, with the best score and without an image match.
    """
    same = image_url_equal(F.col("image_url"), F.col("cand_image"))
    found = offers.select("product_key", F.struct(*offers.columns).alias("offer"), F.round(overlap_score(same, F.col("title"), F.col("cand_title")), 9).alias("score"), same.alias("same"), F.col(order).alias("at"))
    per = found.groupBy("product_key").agg(F.max("score").alias("match_score"), F.min_by(F.struct("offer", "same"), F.struct(-F.col("score"), "at")).alias("best"), F.min_by("offer", "at").alias("first"))
    good = F.col("match_score") >= LEAST_OVERLAP
    return per.select("product_key", F.when(good, F.col("best.offer")).otherwise(F.col("first")).alias("offer"), "match_score", (good & F.col("best.same")).alias("image_match"))


def union_candidates(reverse: DataFrame, search: DataFrame) -> DataFrame:
    """Candidates of both sources, first the reverse-image ones: rank within the product, each offer once."""
    both = reverse.withColumn("__order", F.lit(0)).unionByName(search.withColumn("__order", F.lit(1)))
    first = both.groupBy("product_key", "cand_key").agg(F.min_by(F.struct(*(c for c in both.columns if c not in ("product_key", "cand_key"))), "__order").alias("c")).select("product_key", "cand_key", "c.*")
    w = Window.partitionBy("product_key").orderBy("__order", "cand_key")
    return first.withColumn("rank", F.row_number().over(w)).drop("__order")


def pivot_mapping(best: DataFrame) -> DataFrame:
    """One row a product: per platform the found offer's key, url, price, score, tag, similarities and source, whether it is unavailable, and else an error.

    Only an offer that passes the gate is found. One without a price is unavailable.
    """
    priced = F.coalesce(F.col("cand_price") != "", F.lit(False))
    columns = {"key": "cand_key", "url": "cand_url", "price": F.when(priced, F.col("cand_price")), "score": F.bround("verified", 1), "tag": match_tag(F.col("verified")), "dinov2": F.round("dinov2_sim", 4), "clip": F.round("clip_sim", 4), "source": "source", "unavailable": ~priced}
    offer = F.struct(*((F.col(v) if isinstance(v, str) else v).alias(c) for c, v in columns.items()))
    cells = [F.max_by(F.when(F.col("passes"), offer), F.col("passes").cast("int")).alias("offer"), F.count(F.lit(1)).alias("n")]
    per = best.groupBy("product_key").pivot("platform", list(PLATFORMS)).agg(*cells)
    shown = [(F.coalesce(F.col(f"{p}_offer.{c}"), F.lit(False)) if c == "unavailable" else F.col(f"{p}_offer.{c}")).alias(f"{p}_{c}") for p in PLATFORMS for c in columns]
    errors = [F.when(F.coalesce(F.col(f"{p}_n"), F.lit(0)) == 0, "No match found").when(F.col(f"{p}_offer").isNull(), "Low confidence match").alias(f"{p}_error") for p in PLATFORMS]
    return per.select("product_key", *shown, *errors)


def top_links(candidates: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("product_key", "platform").orderBy("cand_key")
    return candidates.select("product_key", "platform", "cand_key").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (title, image_url) with cached_url, null where the cache has none; the key is an md5 of the cut fields."""
    keyed = requests.withColumn("cache_key", cache_key())
    return keyed.join(cache.where("cached_url is not null"), "cache_key", "left")


def cache_key():
    return F.md5(F.concat(F.substring(F.coalesce("title", F.lit("")), 1, 80), F.lit("|"), F.substring(F.coalesce("image_url", F.lit("")), 1, 120)))
