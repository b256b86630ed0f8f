"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import best_fit_packing, centroid_clustering, chat_format, exact_topk, jump_sharding, language_id, license_scan, ngram_join, piece_lattice, quality_rules, suffix_dedup, token_counts, whitening
from opsframe.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    rows = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(rows)
    return chat_format.conversation_digests(chat_format.prefix_target_examples(turns))


def op2_license_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_notices(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = language_id.predict(spark, docs, language_id.fit(docs))
    return predicted.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(spark, table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encode_texts(spark, table(spark, sf_dir, "documents"), piece_lattice.Pieces(tokenizer_path("piece_bpe_32k.model")))


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_sharding.shard_documents(spark, table(spark, sf_dir, "documents"), 40)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(spark, table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"), 4)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clustering.cluster(spark, table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)
    return found.withColumn("centroid_sha256", centroid_clustering.centroid_digest()).drop("centroid")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_CONTROL = r"([<\[])(/?s>|/?INST\]|</?SYS>>|\|)"
_OP1 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(regexp_replace(replace(r, '\', '\\'), '{_CONTROL}', '\1_\2', 'g')) + length(regexp_replace(replace(t, '\', '\\'), '{_CONTROL}', '\1_\2', 'g')) + 13) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (r = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (r = 'assistant' OR k = n) AS n_examples
FROM e GROUP BY conv_id
"""
_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_OP10 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s, text FROM d),
k AS (SELECT *, CASE WHEN len(s) = 0 THEN 'text' || coalesce(text, '') ELSE sha256(array_to_string(s, '|')) END AS key FROM g),
c AS (SELECT key, min(doc_id) AS copy_id, count(*) AS size, any_value(s) AS s, len(any_value(s)) AS n, min(rid) AS node FROM k GROUP BY key),
e AS (SELECT node, n, size, unnest(s) AS gram FROM c),
p AS (SELECT a.node AS u, b.node AS v, any_value(a.size) AS su, any_value(b.size) AS sv FROM e a JOIN e b ON a.gram = b.gram AND a.node <> b.node GROUP BY a.node, b.node HAVING 5 * count(*) >= 4 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(id, node) AS (SELECT node, node FROM c UNION SELECT r.id, p.v FROM reach r JOIN p ON r.node = p.u),
least AS (SELECT r.id, min(c.copy_id) AS class_id FROM reach r JOIN c ON r.node = c.node GROUP BY r.id),
links AS (SELECT u, sum(sv) AS n FROM p GROUP BY u)
SELECT k.doc_id, least.class_id, c.copy_id, CAST(c.size - 1 + coalesce(links.n, 0) AS BIGINT) AS n_links
FROM k JOIN c ON k.key = c.key JOIN least ON least.id = c.node LEFT JOIN links ON links.u = c.node
"""


def _nearest(name: str, centroids: str) -> str:
    """Each vector's nearest centroid: a struct of the squared distance and the number, the least of which counts."""
    return f"""{name} AS (
  SELECT v.rid, v.vec_id, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS best
  FROM v, {centroids} c GROUP BY v.rid, v.vec_id, v.x)"""


def _moved(name: str, assigned: str, before: str) -> str:
    """Centroids after a round; a floor of the exact mean, and empty ones as before."""
    return f"""{name}_sums AS (
  SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM {assigned}, (SELECT unnest(range(1, 65)) AS i) GROUP BY best.c, i),
{name} AS (
  SELECT b.c, coalesce(m.x, b.x) AS x FROM {before} b
  LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM {name}_sums GROUP BY c) m ON b.c = m.c)"""


_OP12 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v) ORDER BY h NULLS LAST, x LIMIT 16),
{_nearest("a1", "c0")}, {_moved("c1", "a1", "c0")}, {_nearest("a2", "c1")}, {_moved("c2", "a2", "c1")}, {_nearest("a3", "c2")}, {_moved("c3", "a3", "c2")}, {_nearest("a4", "c3")}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a4 JOIN c3 ON a4.best.c = c3.c
"""
_OP13 = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (
  SELECT rid, doc_id, length(h) // 2 AS n, lo, substr(h, 2 * lo + 1, 2 * (1024 + 49)) AS part
  FROM (SELECT *, unnest(range(0, greatest(length(h) // 2, 1), 1024)) AS lo FROM t)),
places AS (SELECT rid, doc_id, n, lo + i AS p, substr(part, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(range(0, least(1024, n - lo))) AS i FROM parts)),
least AS (SELECT g, min(doc_id) AS first FROM places WHERE length(g) = 100 GROUP BY g),
marked AS (
  SELECT b.rid, p, left(b.g, 2) AS byte,
    coalesce(max(CASE WHEN l.first < b.doc_id THEN p END) OVER (PARTITION BY b.rid ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
  FROM places b LEFT JOIN least l ON b.g = l.g),
turns AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY rid ORDER BY p) AS starts FROM marked),
texts AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM turns GROUP BY rid)
SELECT t.doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(x.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(x.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x.kept, ''))) AS kept_sha256
FROM t LEFT JOIN texts x ON t.rid = x.rid
"""


def queries() -> dict:
    found = [op1_chat_prefix_target, op2_license_fuzzy, op3_exact_topk, op4_token_counts, op5_language_id, op6_quality_mcd, op7_best_fit_packing, op8_piece_lattice, op9_jump_sharding, op10_ngram_join, op11_whitening, op12_centroids, op13_suffix_dedup, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_prefix_target": _OP1, "op3_exact_topk": _OP3, "op10_ngram_join": _OP10, "op12_centroids": _OP12, "op13_suffix_dedup": _OP13}
