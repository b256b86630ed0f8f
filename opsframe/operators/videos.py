"""Related videos: relevance, dedup, caps and the order of shorts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.scores import dot, is_short, let, relevance
from opsframe.operators.keyed import first_per_key, top_per_key


def scored(videos: DataFrame, reel: Column | None = None) -> DataFrame:
    """relevance of each video; reels, where a condition for them is given, have 15 more."""
    base = F.round(relevance(F.col("title"), F.col("product_name"), F.col("view_count")), 6)
    return videos.withColumn("relevance", base if reel is None else base + F.when(reel, 15.0).otherwise(0.0))


def merged_warnings(warnings: DataFrame, keys: list[str], column: str = "warnings") -> DataFrame:
    """The distinct texts of all lists of a key, sorted; a key whose lists are all null or empty has an empty list."""
    each = warnings.select(*keys, F.explode_outer(column).alias(column))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set(column)).alias(column))


def top_videos(videos: DataFrame, k: int = 20) -> DataFrame:
    """The first seen of each id, then the best k of all."""
    first = first_per_key(videos, ["id"], ["product_key", "seq"])
    return scored(first).orderBy(F.desc("relevance"), "id").limit(k)


def cap_per_source(videos: DataFrame, k: int = 10) -> DataFrame:
    """The first k videos of each product and platform."""
    return top_per_key(videos, ["product_key", "platform"], [F.col("seq")], k)


def prefer_shorts(videos: DataFrame, k: int = 10, enough: int = 3) -> DataFrame:
    """Per product: only shorts if there are `enough`, else shorts first; k of them."""
    s = scored(videos).withColumn("short", is_short(F.col("duration"), strict=False))
    counts = s.groupBy("product_key").agg(F.count_if("short").alias("n_short"))
    w = Window.partitionBy("product_key").orderBy(F.desc("short"), F.desc("relevance"), "seq")
    kept = s.join(counts, "product_key").where((F.col("n_short") < enough) | F.col("short"))
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Label vectors are a constant of the plan; so many labels at most.
MOST_LABELS = 1000


def label_probabilities(vector: Column, labels: list[tuple[str, list[float]]], scale: float = 10.0) -> Column:
    """array<struct<prob,label>>, most probable first, ties by label: softmax over scaled cosines, within the row.

    labels (label, vector) are one constant. A vector that is null or has no length, or another one than the labels', has null.
    """
    if len(labels) > MOST_LABELS:
        raise ValueError(f"{len(labels)} labels are more than a plan should hold as a constant; at most {MOST_LABELS}")
    unit = [(name, [x / sum(y * y for y in v) ** 0.5 for x in v]) for name, v in labels]
    constant = F.from_json(F.lit(json.dumps([{"label": n, "v": v} for n, v in unit])), "array<struct<label:string,v:array<double>>>")

    def softmax(logits: Column) -> Column:
        top = F.array_max(F.transform(logits, lambda z: z["z"]))
        powers = F.transform(logits, lambda z: F.struct(z["label"].alias("label"), F.exp(z["z"] - top).alias("e")))
        return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda s, x: s + x["e"]), lambda total: F.transform(p, lambda x: F.struct((-F.round(x["e"] / total, 6)).alias("minus"), x["label"].alias("label")))))

    norm = F.sqrt(dot(vector, vector))
    ranked = F.array_sort(softmax(let(norm, lambda n: F.transform(constant, lambda c: F.struct(c["label"].alias("label"), (scale * dot(vector, c["v"]) / n).alias("z"))))))
    fits = vector.isNotNull() & (F.size(vector) == len(unit[0][1]) if unit else F.lit(False)) & (norm > 0)
    return F.when(fits, F.transform(ranked, lambda r: F.struct((-r["minus"]).alias("prob"), r["label"].alias("label"))))


def top_labels(vectors: DataFrame, labels: list[tuple[str, list[float]]], k: int = 5, above: float = 0.0) -> DataFrame:
    """vec_id, label, prob, rank: the k most probable labels of each vector, of those with more than `above`."""
    best = F.filter(F.slice(label_probabilities(F.col("embedding"), labels), 1, k), lambda r: r["prob"] > above)
    each = vectors.select("vec_id", F.posexplode(best).alias("at", "r"))
    return each.select("vec_id", F.col("r.label").alias("label"), F.col("r.prob").alias("prob"), (F.col("at") + 1).alias("rank"))


# Words that go with a category, and words that say nothing about a product.
ACTIONS = ("review", "unboxing", "demo", "test", "in action")
QUERY_FILLERS = "for the a an in on of with and to is it at by new pack set combo".split()


def generated_queries(products: DataFrame, k: int = 8) -> DataFrame:
    """product_key, q, weight, reason, rank: the k best search queries of (product_key, name, categories, features).

    categories is array<struct<category,confidence>>, best first. The first of equal texts stays; equal weights keep their order.
    """

    def item(q, weight, reason):
        return F.struct(q.alias("q"), F.lit(weight).cast("double").alias("weight") if isinstance(weight, float) else weight.alias("weight"), F.lit(reason).alias("reason"))

    def some(condition, struct):
        return F.when(condition, F.array(struct)).otherwise(F.array().cast("array<struct<q:string,weight:double,reason:string>>"))

    def parts(r: Column) -> Column:
        cats, features = r["categories"], r["features"]
        top = F.get(cats, F.lit(0))["category"]
        by_category = F.flatten(
            F.transform(
                F.slice(cats, 1, 3),
                lambda c: F.concat(
                    F.array(item(c["category"], F.bround(c["confidence"], 3), "category")),
                    F.transform(F.array(*map(F.lit, ACTIONS)), lambda a: item(F.concat_ws(" ", c["category"], a), F.bround(c["confidence"] * 0.85, 3), "category+action")),
                ),
            )
        )
        tokens = F.filter(F.split(F.lower(F.trim(r["name"])), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(QUERY_FILLERS))
        terms = F.flatten(F.transform(F.slice(cats, 1, 2), lambda c: F.split(c["category"], " ")))
        broad = F.slice(F.array_sort(F.array_distinct(F.filter(terms, lambda w: (F.length(w) > 3) & ~w.isin(QUERY_FILLERS)))), 1, 3)

        def whole(x: Column) -> Column:
            return F.concat(
                by_category,
                some(F.size(x["t"]) > 0, item(F.array_join(F.slice(x["t"], 1, 5), " "), 0.95, "product_name")),
                some((F.size(x["t"]) > 0) & top.isNotNull(), item(F.concat_ws(" ", F.array_join(F.slice(x["t"], 1, 3), " "), F.element_at(F.split(F.coalesce(top, F.lit("")), " "), -1)), 0.88, "name+category")),
                some((F.size(features) > 0) & top.isNotNull(), item(F.concat_ws(" ", top, F.array_join(F.slice(features, 1, 2), " ")), 0.70, "visual+category")),
                some(F.size(x["b"]) > 0, item(F.array_join(x["b"], " "), 0.60, "broad")),
            )

        # a product without a list has no queries
        return let(F.struct(tokens.alias("t"), broad.alias("b")), lambda x: F.coalesce(whole(x), F.array().cast("array<struct<q:string,weight:double,reason:string>>")))

    def best(queries: Column) -> Column:
        first = let(queries, lambda qs: F.filter(qs, lambda x, i: ~F.exists(F.slice(qs, 1, i), lambda y: y["q"].eqNullSafe(x["q"]))))
        return F.slice(F.array_sort(F.transform(first, lambda x: F.struct((-x["weight"]).alias("less"), x["pos"].alias("pos"), x["q"].alias("q"), x["reason"].alias("reason")))), 1, k)

    # a product's rows come together before they are written out, and its queries never leave their row: nothing of their size is sorted
    rows = products.groupBy("product_key").agg(F.collect_list(F.struct("name", "categories", "features")).alias("rows"))
    placed = F.flatten(F.transform("rows", lambda r: F.transform(parts(r), lambda x, i: F.struct(i.alias("pos"), x["q"].alias("q"), x["weight"].alias("weight"), x["reason"].alias("reason")))))
    # of several rows' queries the earlier places come first
    placed = F.when(F.size("rows") > 1, F.array_sort(placed)).otherwise(placed)
    each = rows.select("product_key", F.posexplode(best(placed)).alias("at", "i"))
    return each.select("product_key", F.col("i.q").alias("q"), (-F.col("i.less")).alias("weight"), F.col("i.reason").alias("reason"), (F.col("at") + 1).alias("rank"))
