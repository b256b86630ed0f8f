"""Price matching and video queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions import scores as S
from opsframe.functions import text as T
from opsframe.functions.text import FILLERS, PACK_PHRASES, STOP_WORDS
from opsframe.operators import matching as M
from opsframe.operators import videos as V
from opsframe.operators.keyed import top_per_key
from opsframe.sources.adapters import view, with_views
from opsframe.sources.readers import scan


def _c(s, d):
    # dealt by product, so that scoring is spread and the groups by product need no further shuffle
    return view(s, d, "candidates_v").repartition("product_key")


def _offers(s, d):
    """Candidates of which some have other titles and none, so that a product may have no good one."""
    other = F.col("product_key") % 3 == 0
    return _c(s, d).withColumns({"cand_title": F.when(other & (F.col("cand_key") % 2 == 0), " other  thing ").when(other, " ").otherwise(F.col("cand_title")), "cand_image": F.when(~other, F.col("cand_image"))})


def _v(s, d):
    return view(s, d, "videos_v").repartition("product_key")


def _links(s, d):
    """The stored links of a product, some with queries, and shop links that no platform has."""
    m = view(s, d, "mappings_v").withColumn("url", F.explode(F.array("amazon_url", F.concat("flipkart_url", F.lit("&lid=1")), F.format_string("https://www.flipkart.com/a/p/itm%d?pid=/dp/", "num"), F.format_string("https://www.meesho.com/b/p/%d#top", "num"), F.lit("https://shop.example/p/1"))))
    return m.where("url is not null").select("product_id", F.col("url").alias("link"))


_LINKS = """lk AS (SELECT product_id, unnest([amazon_url, flipkart_url || '&lid=1', concat('https://www.flipkart.com/a/p/itm', num, '?pid=/dp/'), concat('https://www.meesho.com/b/p/', num, '#top'), 'https://shop.example/p/1']) AS link FROM mappings_v),
lk2 AS (SELECT * FROM lk WHERE link IS NOT NULL)"""


def _labels(s, d):
    """Label vectors: the first vector of each label of the table."""
    e = scan(s, d, "embeddings").where("label is not null and embedding is not null")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).limit(V.MOST_LABELS + 1)
    return sorted((f"label-{r['label']}", [float(x) for x in r["vector"]]) for r in first.collect())


_PROBS = """l AS (SELECT concat('label-', CAST(label AS VARCHAR)) AS label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY label),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL), g AS (SELECT vec_id, label, 10.0 * list_inner_product(x, v) / sqrt(list_inner_product(x, x) * list_inner_product(v, v)) AS z FROM e, l),
p AS (SELECT vec_id, label, round(exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w), 6) AS prob FROM g WINDOW w AS (PARTITION BY vec_id))"""
def _described(s, d):
    """Products with categories and features."""
    return scan(s, d, "part").select(
        F.col("p_partkey").alias("product_key"),
        F.concat("p_name", F.lit(" with a set")).alias("name"),
        F.array(F.struct(F.concat(F.lower("p_type"), F.lit(" widget")).alias("category"), F.lit(0.5).alias("confidence")), F.struct(F.lit("garden chair").alias("category"), F.lit(0.25).alias("confidence"))).cast("array<struct<category:string,confidence:double>>").alias("categories"),
        F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("shiny"), F.lit("metal"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("features"),
    )


_GENERATED = """WITH c AS (SELECT p_partkey AS product_key, trim(replace(concat(' ', p_name, ' '), ' new ', ' ')) AS name, concat(lower(p_type), ' widget') AS c1, p_partkey % 3 = 0 AS f FROM part),
l AS (SELECT product_key, list_concat(
    list_concat([{'q': c1, 'weight': 0.5, 'reason': 'category'}], list_transform(['review', 'unboxing', 'demo', 'test', 'in action'], lambda a: {'q': concat(c1, ' ', a), 'weight': 0.425, 'reason': 'category+action'})),
    list_concat([{'q': 'garden chair', 'weight': 0.25, 'reason': 'category'}], list_transform(['review', 'unboxing', 'demo', 'test', 'in action'], lambda a: {'q': concat('garden chair ', a), 'weight': 0.212, 'reason': 'category+action'})),
    list_concat([{'q': name, 'weight': 0.95, 'reason': 'product_name'}, {'q': concat(name, ' widget'), 'weight': 0.88, 'reason': 'name+category'}],
      list_concat(CASE WHEN f THEN [{'q': concat(c1, ' shiny metal'), 'weight': 0.7, 'reason': 'visual+category'}] ELSE [] END,
        [{'q': array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(c1, ' '), ['garden', 'chair']), lambda w: length(w) > 3)))[1:3], ' '), 'weight': 0.6, 'reason': 'broad'}]))) AS i FROM c),
e AS (SELECT product_key, unnest(range(1, len(i) + 1)) AS pos, i FROM l),
u AS (SELECT product_key, pos, i[pos].q AS q, CAST(i[pos].weight AS DOUBLE) AS weight, i[pos].reason AS reason FROM e QUALIFY row_number() OVER (PARTITION BY product_key, i[pos].q ORDER BY pos) = 1)
SELECT product_key, q, weight, reason, CAST(row_number() OVER (PARTITION BY product_key ORDER BY weight DESC, pos) AS INTEGER) AS rank FROM u"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9_\\s/]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"


def _bigrams(t: str) -> str:
    return f"list_distinct(list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


_BARE = "SELECT *, regexp_replace(image_url, '_512.*', '') AS a, regexp_replace(cand_image, '_256.*', '') AS b FROM candidates_v"
_SAME = "a = b OR (length(a) > 30 AND contains(b, a)) OR (length(b) > 30 AND contains(a, b))"
_OVERLAP = f"""x AS (SELECT *, {_SAME} AS same, list_distinct(list_filter(string_split_regex(lower(title), '\\s+'), lambda w: w <> '')) AS wa, list_distinct(list_filter(string_split_regex(lower(cand_title), '\\s+'), lambda w: w <> '')) AS wb FROM ({_BARE})),
o AS (SELECT *, CASE WHEN same THEN 100.0 ELSE 0.0 END + CASE WHEN len(wa) > 0 AND len(wb) > 0 THEN 50.0 * len(list_intersect(wa, wb)) / greatest(len(wa), len(wb)) ELSE 0.0 END AS points FROM x)"""
#: Offers of which some have other titles and none, so that a product may have no good one.
_OFFERS = "offers AS (SELECT * REPLACE (CASE WHEN product_key % 3 = 0 THEN CASE WHEN cand_key % 2 = 0 THEN ' other  thing ' ELSE ' ' END ELSE cand_title END AS cand_title, CASE WHEN product_key % 3 = 0 THEN NULL ELSE cand_image END AS cand_image) FROM candidates_v)"
_SCORED = f"""tk AS (SELECT *, {_tokens('title')} AS t, {_tokens('cand_title')} AS n FROM ({_BARE})),
bg AS (SELECT *, {_bigrams('t')} AS bt, {_bigrams('n')} AS bn, len(list_intersect(t, n)) AS overlap, CASE WHEN len(t) <= len(n) THEN t ELSE n END AS sh, CASE WHEN len(t) <= len(n) THEN n ELSE t END AS lo FROM tk),
sc AS (SELECT *, CASE WHEN len(t) > 0 AND len(n) > 0 THEN
    7.5 * len(list_filter(sh, lambda w: list_contains(lo, w))) / len(sh)
    + 5.0 * CASE WHEN len(bt) > 0 AND len(bn) > 0 THEN len(list_intersect(bt, bn)) / len(list_distinct(list_concat(bt, bn))) ELSE 0 END
    + 4.0 * overlap / len(list_distinct(list_concat(t, n)))
    + CASE WHEN t[1] = n[1] THEN 1.5 ELSE 0 END
    + CASE WHEN least(CAST(price AS DOUBLE), CAST(cand_price AS DOUBLE)) / greatest(CAST(price AS DOUBLE), CAST(cand_price AS DOUBLE)) >= 0.7 AND cand_price IS NOT NULL THEN 2.0 ELSE 0 END
  ELSE 0 END AS text_score, CAST(bit_count(xor(phash, cand_phash)) AS INTEGER) * 3 AS dist FROM bg),
ph AS (SELECT *, CASE WHEN dist <= 5 THEN 80 WHEN dist <= 10 THEN 68 WHEN dist <= 15 THEN 55 WHEN dist <= 20 THEN 35 WHEN dist <= 25 THEN 20 WHEN dist <= 30 THEN 10 ELSE 0 END AS hs FROM sc),
ms AS (SELECT *, CASE WHEN {_SAME} THEN 100.0 ELSE least((hs + text_score) * CASE WHEN len(t) > 0 AND len(n) > 0 AND overlap <= 1 AND greatest(len(t), len(n)) > 2 THEN 0.85 ELSE 1 END, 100.0) END + CASE WHEN source = 'revimg' THEN 30 ELSE 0 END AS score FROM ph),
vs AS (SELECT *, greatest(score, dinov2_sim * 80, clip_sim * 75) AS verified, CASE WHEN source = 'revimg' THEN NOT (dinov2_sim < 0.45 AND clip_sim < 0.55) ELSE dinov2_sim >= 0.60 AND clip_sim >= 0.65 END AS passes FROM ms)"""
_BEST = f"{_SCORED}, best AS (SELECT * FROM vs WHERE verified > 0 QUALIFY row_number() OVER (PARTITION BY product_key, platform ORDER BY round(verified, 9) DESC, cand_key) = 1)"
_TAG = "CASE WHEN verified >= 85 THEN 'Exact Match' WHEN verified >= 70 THEN 'Match' WHEN verified >= 50 THEN 'Similar' ELSE 'Almost Similar' END"
_NORM = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _norm(c: str) -> str:
    return _NORM.format(c=c)


_REL = f"""rel AS (SELECT *, round(CASE WHEN contains({_norm('title')}, {_norm('product_name')}) THEN 50.0 ELSE 0.0 END
  + 30.0 * len(list_filter(string_split({_norm('product_name')}, ' '), lambda w: length(w) > 2 AND contains({_norm('title')}, w))) / len(string_split({_norm('product_name')}, ' '))
  + CASE WHEN view_count > 0 THEN least(5 * log10(CAST(view_count AS DOUBLE)), 20.0) ELSE 0.0 END, 6) AS relevance FROM {{src}})"""
_SHORT = "CASE WHEN duration IS NULL THEN true ELSE CAST(split_part(duration, ':', 1) AS INT) = 0 AND CAST(split_part(duration, ':', 2) AS INT) <= 60 END"
_DEDUP = "d AS (SELECT * FROM videos_v QUALIFY row_number() OVER (PARTITION BY id ORDER BY product_key, seq) = 1)"

Q = {
    "t1_norm_text": (lambda s, d: scan(s, d, "part").select("p_partkey", T.norm_text(F.concat("p_name", F.lit("!  (New) "), "p_type")).alias("text")), f"SELECT p_partkey, {_norm("concat(p_name, '!  (New) ', p_type)")} AS text FROM part"),
    "t2_match_tokens": (lambda s, d: _c(s, d).select("product_key", "cand_key", F.array_join(T.match_tokens(F.col("cand_title")), " ").alias("tokens")), f"SELECT product_key, cand_key, array_to_string({_tokens('cand_title')}, ' ') AS tokens FROM candidates_v"),
    "t3_name_key": (lambda s, d: _c(s, d).select("product_key", "cand_key", T.name_key(F.col("cand_title")).alias("k")), f"SELECT product_key, cand_key, trim(regexp_replace(regexp_replace(lower(trim(cand_title)), '\\b({PACK_PHRASES})\\b', '', 'g'), '\\s+', ' ', 'g')) AS k FROM candidates_v"),
    "t12_sku_query": (
        lambda s, d: scan(s, d, "part").select("p_partkey", T.sku_query(F.concat("p_name", F.lit(" set "), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("DH666-"), "p_size")).otherwise(F.lower("p_type")))).alias("q")),
        f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('DH666-', CAST(p_size AS VARCHAR)) ELSE array_to_string({_tokens('concat(p_name, chr(32), lower(p_type))')}, ' ') END AS q FROM part",
    ),
    "t13_video_query": (lambda s, d: _v(s, d).select("product_key", "seq", T.video_query(F.concat("title", F.lit(" (large) for the kitchen - UB-163"))).alias("q")), f"SELECT product_key, seq, array_to_string(string_split(trim(regexp_replace(regexp_replace(title, '(?i)\\b({FILLERS})\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' ')[1:4], ' ') AS q FROM videos_v"),
    "t14_generated_queries": (lambda s, d: V.generated_queries(_described(s, d), 12), f"{_GENERATED} QUALIFY rank <= 12"),
    "l2_top_queries": (lambda s, d: V.generated_queries(_described(s, d), 8), f"{_GENERATED} QUALIFY rank <= 8"),
    "n7_bigrams": (lambda s, d: _c(s, d).select("product_key", "cand_key", F.size(T.bigrams(T.match_tokens(F.col("cand_title")))).cast("long").alias("n")), f"WITH tk AS (SELECT *, {_tokens('cand_title')} AS n FROM candidates_v) SELECT product_key, cand_key, len({_bigrams('n')}) AS n FROM tk"),
    "n10_cache_key": (lambda s, d: _c(s, d).select("product_key", "cand_key", F.col("cand_title").alias("title"), F.lit(None).cast("string").alias("image_url")).select("product_key", "cand_key", M.cache_key().alias("k")), "SELECT product_key, cand_key, md5(substr(cand_title, 1, 80) || '|') AS k FROM candidates_v"),
    "n12_bucket_links": (
        lambda s, d: _links(s, d).select("product_id", "link", T.bucket_of_link(F.col("link")).alias("platform")),
        f"WITH {_LINKS} SELECT product_id, link, CASE WHEN contains(bare, 'amazon.in') AND contains(bare, '/dp/') THEN 'amazon' WHEN contains(bare, 'flipkart.com') AND (contains(bare, '/p/') OR contains(bare, '/product/')) THEN 'flipkart' WHEN contains(bare, 'meesho.com') AND contains(bare, '/p/') THEN 'meesho' END AS platform FROM (SELECT *, split_part(split_part(link, '?', 1), '#', 1) AS bare FROM lk2)",
    ),
    "m6_phash_score": (lambda s, d: _c(s, d).select("product_key", "cand_key", S.phash_score(S.hamming64(F.col("phash"), F.col("cand_phash")) * 3).alias("hs")), f"WITH {_SCORED} SELECT product_key, cand_key, CAST(hs AS DOUBLE) AS hs FROM ph"),
    "m7_image_url_equal": (
        lambda s, d: _c(s, d).select("product_key", "cand_key", S.image_url_equal(F.col("image_url"), F.col("cand_image")).alias("same")),
        f"SELECT product_key, cand_key, {_SAME} AS same FROM ({_BARE})",
    ),
    "m8_text_score": (lambda s, d: M.score_candidates(_c(s, d), 3).select("product_key", "cand_key", F.round("text_score", 6).alias("text_score")), f"WITH {_SCORED} SELECT product_key, cand_key, round(text_score, 6) AS text_score FROM sc"),
    "m9_match_score": (lambda s, d: M.score_candidates(_c(s, d), 3).select("product_key", "cand_key", F.round("score", 6).alias("score")), f"WITH {_SCORED} SELECT product_key, cand_key, round(score, 6) AS score FROM ms"),
    "m10_verified_score": (lambda s, d: M.score_candidates(_c(s, d), 3).select("product_key", "cand_key", F.round("verified", 6).alias("verified")), f"WITH {_SCORED} SELECT product_key, cand_key, round(verified, 6) AS verified FROM vs"),
    "m11_match_gate": (lambda s, d: M.score_candidates(_c(s, d), 3).groupBy("platform", "source", "passes", "reliable").agg(F.count("*").alias("n")), f"WITH {_SCORED} SELECT platform, source, passes, verified >= 35 AS reliable, count(*) AS n FROM vs GROUP BY 1, 2, 3, 4"),
    "m12_overlap_score": (
        lambda s, d: _c(s, d).select("product_key", "cand_key", F.round(S.overlap_score(S.image_url_equal(F.col("image_url"), F.col("cand_image")), F.col("title"), F.col("cand_title")), 6).alias("score")),
        f"WITH {_OVERLAP} SELECT product_key, cand_key, round(points, 6) AS score FROM o",
    ),
    "m12_best_overlap": (
        lambda s, d: M.best_overlap(_offers(s, d), "cand_key").select("product_key", F.col("offer.cand_key").alias("cand_key"), F.col("offer.cand_title").alias("title"), F.round("match_score", 6).alias("match_score"), "image_match"),
        f"WITH {_OVERLAP.replace('FROM candidates_v', 'FROM offers').replace('x AS', _OFFERS + ', x AS', 1)}, r AS (SELECT *, max(round(points, 9)) OVER w AS best, row_number() OVER (PARTITION BY product_key ORDER BY round(points, 9) DESC, cand_key) AS k, row_number() OVER (PARTITION BY product_key ORDER BY cand_key) AS first FROM o WINDOW w AS (PARTITION BY product_key)) SELECT product_key, cand_key, cand_title AS title, round(best, 6) AS match_score, best >= 10 AND same AS image_match FROM r WHERE CASE WHEN best >= 10 THEN k = 1 ELSE first = 1 END",
    ),
    "w1_best_candidate": (lambda s, d: M.best_candidate(M.score_candidates(_c(s, d), 3)).select("product_key", "platform", "cand_key", F.round("verified", 6).alias("verified")), f"WITH {_BEST} SELECT product_key, platform, cand_key, round(verified, 6) AS verified FROM best"),
    "t15_match_tag": (lambda s, d: M.best_candidate(M.score_candidates(_c(s, d), 3)).groupBy(S.match_tag(F.col("verified")).alias("tag")).agg(F.count("*").alias("n")), f"WITH {_BEST} SELECT {_TAG} AS tag, count(*) AS n FROM best GROUP BY 1"),
    "u2_union_candidates": (
        lambda s, d: M.union_candidates(_c(s, d).where("source = 'revimg'"), _c(s, d).where("source = 'search' or cand_key % 2 = 0")).select("product_key", "cand_key", "source", "rank"),
        "WITH c AS (SELECT product_key, cand_key, source, source = 'revimg' AS rev FROM candidates_v WHERE source IN ('revimg', 'search') OR cand_key % 2 = 0) SELECT product_key, cand_key, source, CAST(row_number() OVER (PARTITION BY product_key ORDER BY rev DESC, cand_key) AS INTEGER) AS rank FROM c",
    ),
    "u3_token_sets": (
        lambda s, d: _c(s, d).select("product_key", "cand_key", S.let(T.token_sets(T.match_tokens(F.col("title")), T.match_tokens(F.col("cand_title"))), lambda x: F.struct(F.size(x["both"]).cast("long").alias("both_n"), F.size(x["either"]).cast("long").alias("either_n"), F.size(x["only"]).cast("long").alias("only_n"))).alias("n")).select("product_key", "cand_key", "n.*"),
        f"WITH {_SCORED} SELECT product_key, cand_key, overlap AS both_n, len(list_distinct(list_concat(t, n))) AS either_n, len(list_filter(list_distinct(t), lambda w: NOT list_contains(n, w))) AS only_n FROM bg",
    ),
    "u7_pivot_mapping": (
        lambda s, d: M.pivot_mapping(M.best_candidate(M.score_candidates(_c(s, d), 3))),
        f"WITH {_BEST} SELECT product_key, "
        + ", ".join(
            f"{agg} FILTER (platform = '{p}' AND passes) AS {p}_{c}"
            for p in M.PLATFORMS
            for c, agg in {"key": "max(cand_key)", "url": "max(cand_url)", "price": "max(NULLIF(cand_price, ''))", "score": "max(round_even(verified, 1))", "tag": f"max({_TAG})", "dinov2": "max(dinov2_sim)", "clip": "max(clip_sim)", "source": "max(source)"}.items()
        )
        + ", "
        + ", ".join(
            f"coalesce(bool_or(coalesce(cand_price, '') = '') FILTER (platform = '{p}' AND passes), false) AS {p}_unavailable, CASE WHEN count(*) FILTER (platform = '{p}') = 0 THEN 'No match found' WHEN count(*) FILTER (platform = '{p}' AND passes) = 0 THEN 'Low confidence match' END AS {p}_error"
            for p in M.PLATFORMS
        )
        + " FROM best GROUP BY product_key",
    ),
    "w5_top_links": (lambda s, d: M.top_links(_c(s, d), 3), "SELECT product_key, platform, cand_key, CAST(row_number() OVER (PARTITION BY product_key, platform ORDER BY cand_key) AS INTEGER) AS rank FROM (SELECT DISTINCT product_key, platform, cand_key FROM candidates_v) QUALIFY rank <= 3"),
    "m13_relevance": (lambda s, d: V.scored(_v(s, d)).select("product_key", "seq", "relevance"), f"WITH {_REL.format(src='videos_v')} SELECT product_key, seq, relevance FROM rel"),
    "m14_iso_duration": (
        lambda s, d: scan(s, d, "part").select("p_partkey", S.iso_duration(F.concat(F.lit("PT"), F.when(F.col("p_partkey") % 2 == 0, "1H").otherwise(""), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit("M"))).otherwise(""), F.when(F.col("p_partkey") % 5 == 0, "7S").otherwise(""))).alias("shown")),
        "SELECT p_partkey, concat(CASE WHEN p_partkey % 2 = 0 THEN '1:' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 AND p_size < 10 THEN concat('0', CAST(p_size AS VARCHAR)) ELSE CAST(p_size AS VARCHAR) END ELSE '0' END, ':', CASE WHEN p_partkey % 5 = 0 THEN '07' ELSE '00' END) AS shown FROM part",
    ),
    "f14_is_short": (lambda s, d: _v(s, d).select("product_key", "seq", S.is_short(F.col("duration")).alias("short")), f"SELECT product_key, seq, {_SHORT} AS short FROM videos_v"),
    "t18_view_count": (lambda s, d: _v(s, d).select("product_key", "seq", S.view_count(F.concat(F.lit("by x, "), F.format_number("view_count", 0), F.lit(" views"))).alias("n")), "SELECT product_key, seq, view_count AS n FROM videos_v"),
    "l1_top_videos": (lambda s, d: V.top_videos(_v(s, d), 20).select("id", "relevance"), f"WITH {_DEDUP}, {_REL.format(src='d')} SELECT id, relevance FROM rel ORDER BY relevance DESC, id LIMIT 20"),
    "w6_cap_per_source": (lambda s, d: V.cap_per_source(_v(s, d), 10).select("product_key", "platform", "seq", "rank"), "SELECT product_key, platform, seq, CAST(row_number() OVER (PARTITION BY product_key, platform ORDER BY seq) AS INTEGER) AS rank FROM videos_v QUALIFY rank <= 10"),
    "w7_prefer_shorts": (
        lambda s, d: V.prefer_shorts(_v(s, d), 10).select("product_key", "seq", "short", "rank"),
        f"WITH {_REL.format(src='videos_v')}, sh AS (SELECT *, {_SHORT} AS short FROM rel), c AS (SELECT *, count(*) FILTER (short) OVER (PARTITION BY product_key) AS n_short FROM sh) SELECT product_key, seq, short, CAST(row_number() OVER (PARTITION BY product_key ORDER BY short DESC, relevance DESC, seq) AS INTEGER) AS rank FROM c WHERE n_short < 3 OR short QUALIFY rank <= 10",
    ),
    "w8_top_labels": (lambda s, d: V.top_labels(scan(s, d, "embeddings").select("vec_id", "embedding"), _labels(s, d), 5), f"WITH {_PROBS} SELECT vec_id, label, prob, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, label) AS INTEGER) AS rank FROM p QUALIFY rank <= 5"),
    "w8_top_features": (
        lambda s, d: V.top_labels(scan(s, d, "embeddings").select("vec_id", "embedding"), _labels(s, d), 5, 0.1),
        f"WITH {_PROBS}, r AS (SELECT vec_id, label, prob, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, label) AS INTEGER) AS rank FROM p QUALIFY rank <= 5) SELECT * FROM r WHERE prob > 0.1",
    ),
    "u4_warnings_distinct": (lambda s, d: _v(s, d).groupBy("product_key").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.substring("title", 1, 3), F.coalesce("duration", F.lit("-"))))))), ",").alias("w")), "WITH x AS (SELECT product_key, unnest([substr(title, 1, 3), coalesce(duration, '-')]) AS w FROM videos_v) SELECT product_key, string_agg(DISTINCT w, ',' ORDER BY w) AS w FROM x GROUP BY 1"),
}


def queries() -> dict:
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: with_views(sql) for k, (_, sql) in Q.items() if sql}
