"""Duplicate detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions import scores as S
from opsframe.operators import duplicates as D
from opsframe.operators import lsh
from opsframe.sources.adapters import view, with_views
from opsframe.sources.readers import scan

#: The driver's vectors have few close pairs; at the usual 0.80 the result would be empty.
LEAST = 0.40


def _p(s, d):
    return view(s, d, "products_v")


def _hashed(s, d, mapped: bool):
    """Products with a hash, those with or without a mapping."""
    known = view(s, d, "mappings_v").select(F.col("product_id").alias("id"))
    own = D.met_by_sort(_p(s, d), known, ["id"], "left_semi" if mapped else "left_anti")
    return own.select("id", "brand", ((F.col("num") * 2654435761) % 1048576).alias("phash"))


def _wide(s, d, mapped: bool):
    """As _hashed, with hashes of 64 bits: 97 far apart, and three bits of each flipped by the product's number."""
    base = F.expr("cast(cast(num % 97 as decimal(38,0)) * 11400714819323198485 % 18446744073709551616 - 9223372036854775808 as bigint)")
    bit = lambda n: F.expr(f"shiftleft(1L, cast({n} as int))")
    own = D.met_by_sort(_p(s, d), view(s, d, "mappings_v").select(F.col("product_id").alias("id")), ["id"], "left_semi" if mapped else "left_anti")
    return own.select("id", "brand", base.bitwiseXOR(bit("num % 61")).bitwiseXOR(bit("num * 7 % 53")).bitwiseXOR(bit("num * 3 % 37")).alias("phash"))


def _fallback(s, d):
    """Unmapped products without a hit in their brand, against all mapped ones."""
    unmapped, mapped = _wide(s, d, False), _wide(s, d, True)
    return D.fallback_candidates(s, D.without_candidates(s, unmapped, mapped, 5), mapped, 8)


#: The usual threshold, for vectors with copies.
ALIKE = 0.80


def _copies(s, d):
    """All vectors, and for some a copy of other length and a copy with some signs turned, whose cosines lie about the threshold."""
    e = scan(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    longer = e.where("vec_id % 11 = 0").select((F.col("vec_id") + 10**9).alias("vec_id"), F.transform("embedding", lambda x: x * 2).alias("embedding"))
    turned = e.where("vec_id % 7 = 0").select((F.col("vec_id") + 2 * 10**9).alias("vec_id"), F.transform("embedding", lambda x, i: F.when((i + F.col("vec_id")) % 10 == 0, -x).otherwise(x)).alias("embedding"))
    return e.unionByName(longer).unionByName(turned)


_COPIES = """own AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings), copies AS (SELECT * FROM own UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x: x * 2) FROM own WHERE vec_id % 11 = 0
  UNION ALL SELECT vec_id + 2000000000, list_transform(embedding, lambda x, i: CASE WHEN (i - 1 + vec_id) % 10 = 0 THEN -x ELSE x END) FROM own WHERE vec_id % 7 = 0)"""


def _pairs(s, d):
    return D.similar_pairs(scan(s, d, "embeddings"), LEAST)


_GROUPS = "g AS (SELECT lower(trim(name)) AS k_name, price AS k_price, lower(trim(brand)) AS k_brand, count(*) AS size, min(id) AS first_id, list(id ORDER BY id) AS members FROM products_v WHERE coalesce(name, '') <> '' AND coalesce(price, '') <> '' AND coalesce(brand, '') <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1)"
_PAIRS = f"""pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS similarity
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON a.vec_id < b.vec_id
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= {LEAST})"""
_COMP = "both_ AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs), reach(id, node) AS (SELECT src, src FROM both_ UNION SELECT r.id, b.dst FROM reach r JOIN both_ b ON r.node = b.src), comp AS (SELECT id, min(node) AS component FROM reach GROUP BY id)"
_HASHED = "h AS (SELECT id, num, brand, (num * 2654435761) % 1048576 AS phash, id IN (SELECT product_id FROM mappings_v) AS mapped FROM products_v)"

_WIDE = """h AS (SELECT id, brand, xor(xor(xor(CAST((num % 97)::HUGEINT * 11400714819323198485::HUGEINT % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT), 1::BIGINT << (num % 61)), 1::BIGINT << (num * 7 % 53)), 1::BIGINT << (num * 3 % 37)) AS phash,
  id IN (SELECT product_id FROM mappings_v) AS mapped FROM products_v),
b AS (SELECT u.id, m.id AS mapped_id, CAST(bit_count(xor(u.phash, m.phash)) AS INTEGER) AS distance FROM h u JOIN h m ON upper(trim(u.brand)) = upper(trim(m.brand)) WHERE NOT u.mapped AND m.mapped AND bit_count(xor(u.phash, m.phash)) < 5)"""
_ALIKE = f"WITH RECURSIVE {_COPIES}, " + _PAIRS.replace(f">= {LEAST})", f">= {ALIKE})").replace("FROM embeddings)", "FROM copies)")

Q = {
    "j7_wide_candidates": (lambda s, d: D.block_candidates(_wide(s, d, False), _wide(s, d, True), 5), f"WITH {_WIDE} SELECT * FROM b"),
    "j8_fallback_candidates": (
        _fallback,
        f"WITH {_WIDE}, p AS (SELECT u.id, m.id AS mapped_id, CAST(bit_count(xor(u.phash, m.phash)) AS INTEGER) AS distance FROM h u JOIN h m ON bit_count(xor(u.phash, m.phash)) < 8 WHERE NOT u.mapped AND m.mapped AND u.id NOT IN (SELECT id FROM b)) SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, mapped_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 3",
    ),
    "j9_lsh_pairs": (lambda s, d: lsh.similar_pairs(s, _copies(s, d), ALIKE).select("src", "dst", F.bround("similarity", 4).alias("similarity")), f"{_ALIKE} SELECT src, dst, round_even(similarity, 4) AS similarity FROM pairs"),
    "a3_lsh_components": (lambda s, d: D.similarity_components(s, lsh.similarity_links(s, _copies(s, d), ALIKE)), f"{_ALIKE}, {_COMP} SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM comp"),
    "a4_lsh_survivors": (
        lambda s, d: D.survivors(D.similarity_components(s, lsh.similarity_links(s, _copies(s, d), ALIKE))),
        f"{_ALIKE}, {_COMP} SELECT id, component, CASE WHEN row_number() OVER (PARTITION BY component ORDER BY CAST(id AS VARCHAR)) = 1 THEN 'keep' ELSE 'delete' END AS action FROM comp",
    ),
    "a1_exact_duplicates": (lambda s, d: D.exact_duplicates(_p(s, d)), f"WITH {_GROUPS} SELECT k_name, k_price, k_brand, first_id, size FROM g"),
    "a2_duplicate_summary": (lambda s, d: D.duplicate_summary(D.exact_duplicates(_p(s, d))), f"WITH {_GROUPS} SELECT count(*) AS n_groups, CAST(coalesce(sum(size - 1), 0) AS BIGINT) AS surplus FROM g"),
    "j10_group_pairs": (lambda s, d: D.group_pairs(_p(s, d)), f"WITH {_GROUPS} SELECT first_id AS id1, unnest(members[2:]) AS id2 FROM g"),
    "j11_attach_scores": (
        lambda s, d: D.attach_scores(D.group_pairs(_p(s, d)), _p(s, d).where("num % 2 = 0").select(F.col("id").alias("id2"), F.lit(0.9).alias("score")).join(D.group_pairs(_p(s, d)), "id2").select("id1", "id2", "score")),
        f"WITH {_GROUPS}, x AS (SELECT first_id AS id1, unnest(members[2:]) AS id2 FROM g) SELECT id1, id2, CASE WHEN CAST(substr(id2, 3) AS BIGINT) % 2 = 0 THEN 0.9::DOUBLE END AS score FROM x",
    ),
    "j7_block_candidates": (
        lambda s, d: D.block_candidates(_hashed(s, d, False), _hashed(s, d, True), 4, 20),
        f"WITH {_HASHED} SELECT u.id, m.id AS mapped_id, CAST(bit_count(xor(u.phash, m.phash)) AS INTEGER) AS distance FROM h u JOIN h m ON upper(trim(u.brand)) = upper(trim(m.brand)) WHERE NOT u.mapped AND m.mapped AND bit_count(xor(u.phash, m.phash)) < 4",
    ),
    "j8_global_candidates": (
        lambda s, d: D.global_candidates(_hashed(s, d, False), _hashed(s, d, True), 4, 20),
        f"WITH {_HASHED}, p AS (SELECT u.id, m.id AS mapped_id, CAST(bit_count(xor(u.phash, m.phash)) AS INTEGER) AS distance FROM h u JOIN h m ON bit_count(xor(u.phash, m.phash)) < 4 WHERE NOT u.mapped AND m.mapped) SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, mapped_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 3",
    ),
    "w2_nearest_mapped": (
        lambda s, d: D.nearest_in_brand(s, _hashed(s, d, False), _hashed(s, d, True), 6, 20),
        f"WITH {_HASHED}, p AS (SELECT u.id, m.id AS mapped_id, CAST(bit_count(xor(u.phash, m.phash)) AS INTEGER) AS distance FROM h u JOIN h m ON upper(trim(u.brand)) = upper(trim(m.brand)) WHERE NOT u.mapped AND m.mapped AND bit_count(xor(u.phash, m.phash)) < 6) SELECT id, mapped_id, distance FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, mapped_id) = 1",
    ),
    "j9_similar_pairs": (lambda s, d: _pairs(s, d).select("src", "dst", F.bround("similarity", 4).alias("similarity")), f"WITH {_PAIRS} SELECT src, dst, round_even(similarity, 4) AS similarity FROM pairs"),
    "a3_components": (lambda s, d: D.similarity_components(s, _pairs(s, d)), f"WITH RECURSIVE {_PAIRS}, {_COMP} SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM comp"),
    "a4_survivors": (lambda s, d: D.survivors(D.similarity_components(s, _pairs(s, d))), f"WITH RECURSIVE {_PAIRS}, {_COMP} SELECT id, component, CASE WHEN row_number() OVER (PARTITION BY component ORDER BY CAST(id AS VARCHAR)) = 1 THEN 'keep' ELSE 'delete' END AS action FROM comp"),
    "m4_hamming64": (lambda s, d: _p(s, d).select("id", S.hamming64(F.col("num") * 7919, F.col("num") * 104729).alias("distance")), "SELECT id, CAST(bit_count(xor(num * 7919, num * 104729)) AS INTEGER) AS distance FROM products_v"),
    "m5_cosine": (
        lambda s, d: D.pair_cosines(scan(s, d, "embeddings").select(F.col("vec_id").alias("id1"), (F.col("vec_id") + 1).alias("id2")), scan(s, d, "embeddings")),
        "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id AS id1, b.vec_id AS id2, round_even(greatest(least(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 1.0), 0.0), 4) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
    ),
}


def queries() -> dict:
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, (_, sql) in Q.items():
        if sql.startswith("WITH RECURSIVE "):
            out[k] = sql
        elif sql:
            out[k] = with_views(sql)
    return out
