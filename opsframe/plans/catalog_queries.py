"""Catalog queries over products, snapshots and mappings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsframe.functions import scores as S
from opsframe.functions import text as T
from opsframe.operators import catalog as C
from opsframe.operators import keyed as K
from opsframe.operators import duplicates, matching
from opsframe.operators.graph import shared_folder
from opsframe.sources import readers
from opsframe.sources.adapters import view, with_views
from opsframe.sources.stored import StoredTable


def _p(s, d):
    return view(s, d, "products_v")


def _stored(s, d):
    return view(s, d, "stored_v")


def _snap(s, d):
    return view(s, d, "snapshot_v")


def _map(s, d):
    return view(s, d, "mappings_v")


def _gate(s, d):
    return view(s, d, "gateway_v")


def _active(s, d):
    return _snap(s, d).select("item_id").union(_snap(s, d).where("num % 10 = 1").select("item_id"))


def _updates(s, d):
    return _snap(s, d).select(F.concat(F.lit("p-"), F.col("item_id")).alias("id"), F.upper("name").alias("name"), F.when(F.col("num") % 3 != 0, "0").alias("price")).where("id not like '%5'")


def _changed(s, rows, key, change):
    """A stored table of rows, after a change."""
    table = StoredTable.create(s, f"{shared_folder(s)}/opsframe/table-{uuid.uuid4().hex}", rows, [key], 16)
    change(table)
    return table.read()


def _bodies(s, d):
    """Gateway JSON made of the parts."""
    sku = F.format_string('{"isDefault":%d,"price":"%d"}', (F.col("num") % 2).cast("int"), (F.col("num") * 10).cast("bigint"))
    extra = F.format_string('{"isDefault":0,"price":"%d"}', F.col("num").cast("bigint"))
    body = F.concat(F.lit('{"price":"7","brandName":"'), F.coalesce("brand", F.lit("")), F.lit('","Category":[{"categoryName":"'), F.coalesce("category", F.lit("none")), F.lit('"}],"skuList":['), F.when(F.col("num") % 5 != 0, F.concat(extra, F.lit(","), sku)).otherwise(""), F.lit("]}"))
    return _p(s, d).select("id", body.alias("body"))


def _sheet(s, d):
    """Rows to scrape: links of two platforms, unsupported and empty ones, some done."""
    other = F.when(F.col("num") % 14 == 0, F.concat(F.lit("https://shop.example/"), "num")).otherwise(F.lit("  "))
    return _map(s, d).select(F.col("num").alias("row"), F.coalesce("amazon_url", "flipkart_url", other).alias("url"), F.when(F.col("amazon_unavailable"), " Success").alias("status"))


_SHEET = "sheet AS (SELECT num AS row, coalesce(amazon_url, flipkart_url, CASE WHEN num % 14 = 0 THEN concat('https://shop.example/', num) ELSE '' END) AS url, CASE WHEN amazon_unavailable THEN ' Success' END AS status FROM mappings_v)"


def _items(s, d):
    """Item JSON, one array a product, with alternate fields, repeated ids and bodies that are no array."""
    n = F.col("num")
    fields = F.struct(
        F.when(n % 2 == 0, n - n % 4).cast("string").alias("productId"), n.cast("string").alias("skuId"),
        F.when(n % 10 < 5, F.col("name")).alias("productName"), F.when(n % 10 > 5, F.col("name")).alias("variantName"),
        F.when(n % 3 == 0, "").otherwise(F.concat((n * 11).cast("string"), F.lit(".50"))).alias("price"), (n * 7 + 100000).alias("mrpPrice"),
        F.when(n % 7 > 1, "c/").alias("containerName"), F.when(n % 7 == 1, F.concat(F.lit("https://other.example/"), n)).when(n % 7 > 1, F.concat(n, F.lit(".jpg"))).alias("image"),
        F.when(n % 6 != 0, F.concat(F.lit("slug-"), n)).alias("productSlug"), n.alias("itemId"),
        F.when(n % 4 < 2, "slug").alias("categorySlug"), F.lit("named").alias("categoryName"),
    )
    good = _p(s, d).select(n.alias("seq"), F.concat(F.lit("["), F.to_json(fields), F.lit("]")).alias("body"))
    return good.unionByName(_p(s, d).where("num % 50 = 0").select(n.alias("seq"), F.lit("[{broken").alias("body")))


def _xml(s, d):
    """Sitemaps of 500 products at most, as many as the catalog needs."""
    entry = F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc>"), F.when(F.col("image_url").isNotNull(), F.concat(F.lit("<image:image><image:loc>"), F.col("image_url"), F.lit("</image:loc><image:title>"), F.col("name"), F.lit("</image:title></image:image>"))).otherwise(""), F.lit("</url>"))
    return _p(s, d).groupBy(F.expr("num div 500").alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("num", entry.alias("entry")))), lambda e: e["entry"]), "").alias("text"))


_ST = r"regexp_replace(coalesce(NULLIF(image_url, ''), found), '^https://resize[.]shop[.]example/V[^/]+/(https?://.*)', '\1')"
_STATUS = """st AS (SELECT p.id, p.name, m.product_id IS NOT NULL AS attempted, coalesce(amazon_url IS NOT NULL OR flipkart_url IS NOT NULL, false) AS mapped, search_error IS NOT NULL AS duplicate FROM products_v p LEFT JOIN mappings_v m ON p.id = m.product_id)"""
_GROUPED = r"CASE WHEN length(n) > 3 THEN regexp_replace(CASE WHEN (length(n) - 3) % 2 = 1 THEN substr(n, 1, 1) || CASE WHEN length(n) > 4 THEN ',' ELSE '' END || regexp_replace(substr(n, 2, length(n) - 4), '(..)', '\1,', 'g') ELSE regexp_replace(substr(n, 1, length(n) - 3), '(..)', '\1,', 'g') END, ',$', '') || ',' || right(n, 3) ELSE n END"

Q = {
    "s1_scan": (lambda s, d: readers.scan(s, d, "part", ["p_partkey", "p_brand"]), "SELECT p_partkey, p_brand FROM part"),
    "s4_parse_sitemaps": (
        lambda s, d: readers.parse_sitemaps(_xml(s, d)),
        "SELECT CAST(num AS VARCHAR) AS item_id, url, CASE WHEN image_url IS NULL THEN 'Unknown Product' ELSE name END AS title, image_url FROM products_v",
    ),
    "s4_sitemaps_by_position": (
        lambda s, d: readers.parse_sitemaps_by_position(_xml(s, d)),
        "WITH e AS (SELECT *, row_number() OVER (PARTITION BY num // 500 ORDER BY num) AS at, row_number() OVER (PARTITION BY num // 500, image_url IS NULL ORDER BY num) AS img FROM products_v) SELECT CAST(a.num AS VARCHAR) AS item_id, a.url, coalesce(b.name, 'Unknown Product') AS title, b.image_url FROM e a LEFT JOIN e b ON a.num // 500 = b.num // 500 AND a.at = b.img AND b.image_url IS NOT NULL",
    ),
    "s8_parse_gateway": (
        lambda s, d: readers.parse_gateway(_bodies(s, d)).drop("mrp_price"),
        "SELECT id, CASE WHEN num % 5 = 0 THEN '7' WHEN num % 2 = 1 THEN CAST(num * 10 AS VARCHAR) ELSE CAST(num AS VARCHAR) END AS price, coalesce(category, 'none') AS category, coalesce(brand, '') AS brand FROM products_v",
    ),
    "s9_parse_search_results": (
        lambda s, d: readers.parse_search_results(_p(s, d).select("id", F.concat(F.when(F.col("num") % 2 == 0, '{"data":').otherwise(""), F.lit('[{"title":"'), F.when(F.col("num") % 3 == 0, "").otherwise(F.col("name")), F.lit('","name":"n","link":"'), F.col("url"), F.lit('","sellingPrice":"5"}]'), F.when(F.col("num") % 2 == 0, "}").otherwise("")).alias("body"))),
        "SELECT id, 0 AS rank, CASE WHEN num % 3 = 0 THEN 'n' ELSE name END AS title, url, '5' AS price FROM products_v",
    ),
    "s10_parse_audit": (
        lambda s, d: readers.parse_audit(_p(s, d).select(F.col("id").alias("page"), F.format_string('{"categories":{"performance":{"score":0.%d}},"audits":{"cumulative-layout-shift":{"numericValue":%d.125}}}', (F.col("num") % 10).cast("int"), (F.col("num") % 7).cast("int")).alias("report"))),
        "SELECT id AS page, 'performance_score' AS metric, CAST((num % 10) * 10 AS DOUBLE) AS value FROM products_v UNION ALL SELECT id, 'cls', CAST(num % 7 AS DOUBLE) + 0.12 FROM products_v",
    ),
    "s11_parse_field_data": (
        lambda s, d: readers.parse_field_data(_p(s, d).select(F.col("id").alias("page"), F.format_string('{"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":%d}}}}', F.col("num").cast("int")).alias("report"))),
        "SELECT id AS page, 0.0::DOUBLE AS score, CAST(num AS DOUBLE) AS lcp, 0.0::DOUBLE AS cls, 0.0::DOUBLE AS inp FROM products_v",
    ),
    "f1_search_catalog": (lambda s, d: C.search_catalog(_p(s, d), "Red  WIDGET!").select("id", "name"), "SELECT id, name FROM products_v WHERE contains(name, 'red widget') OR contains(regexp_replace(url, '[^a-z0-9_]+', ' ', 'g'), 'red widget')"),
    "f2_paginate": (
        lambda s, d: K.paginate(_p(s, d).select("id", "name"), 7, 20, ["name", "id"]),
        "SELECT id, name, (SELECT count(*) FROM products_v) AS total, CAST(ceil((SELECT count(*) FROM products_v) / 20.0) AS BIGINT) AS total_pages FROM products_v ORDER BY name, id LIMIT 20 OFFSET 120",
    ),
    "f3_range_select": (
        lambda s, d: K.range_select(_p(s, d).select("id", "name"), ["name", "id"], 101, 250),
        "SELECT * FROM (SELECT id, name, row_number() OVER (ORDER BY name, id) AS position FROM products_v) WHERE position BETWEEN 101 AND 250",
    ),
    "f4_needs_enrichment": (
        lambda s, d: C.needs_enrichment(_p(s, d), 1000).select("id"),
        "SELECT id FROM products_v WHERE coalesce(price, '') = '' OR coalesce(category, '') = '' OR coalesce(brand, '') = '' OR coalesce(mrp_price, '') = '' OR (CAST(price AS BIGINT) > 0 AND CAST(price AS BIGINT) < 1000)",
    ),
    "f5_missing_fields": (
        lambda s, d: K.union_dedup([C.missing_fields(_p(s, d), "brand"), C.missing_fields(_p(s, d), "category")], "id", ["num"]).select("id", "brand", "category"),
        "SELECT id, brand, category FROM products_v WHERE brand IS NULL OR category IS NULL",
    ),
    "f5_missing_prices": (
        lambda s, d: C.missing_fields(_p(s, d), "price").orderBy("num").limit(50).select("id", "price", "mrp_price"),
        "SELECT id, price, mrp_price FROM products_v WHERE price IS NULL OR mrp_price IS NULL ORDER BY num LIMIT 50",
    ),
    "f3_range_to_end": (
        lambda s, d: K.range_select(_p(s, d).select("id", "name"), ["name", "id"], 51, 0),
        "SELECT * FROM (SELECT id, name, row_number() OVER (ORDER BY name, id) AS position FROM products_v) WHERE position > 50",
    ),
    "f10_plan_scrape": (
        lambda s, d: C.plan_scrape(_sheet(s, d)).select("row", "platform", "outcome", "error"),
        f"WITH {_SHEET} SELECT row, CASE WHEN url LIKE '%amazon%' THEN 'amazon' WHEN url LIKE '%flipkart%' THEN 'flipkart' END AS platform, CASE WHEN url = '' OR url LIKE '%shop.example%' THEN 'failed' ELSE 'scrape' END AS outcome, CASE WHEN url = '' THEN 'Empty URL' WHEN url LIKE '%shop.example%' THEN concat('Unsupported domain: ', url) END AS error FROM sheet WHERE status IS NULL OR status <> ' Success'",
    ),
    "f11_todo": (
        lambda s, d: C.todo(_p(s, d), _map(s, d).select(F.col("product_id").alias("id")), "id", ["num"], 100).select("id"),
        "SELECT id FROM products_v WHERE id NOT IN (SELECT product_id FROM mappings_v) ORDER BY num LIMIT 100",
    ),
    "s12_parse_items": (
        lambda s, d: C.parse_items(_items(s, d), "https://shop.example", "https://img.shop.example"),
        """WITH i AS (SELECT num, CASE WHEN num % 2 = 0 THEN num - num % 4 ELSE num END AS key, name, CASE WHEN num % 3 = 0 THEN num * 7 + 100000 ELSE num * 11 END AS v FROM products_v)
SELECT 'item-' || key AS id, CASE WHEN num % 10 = 5 THEN 'Unknown Product' ELSE name END AS name,
  '₹' || CASE WHEN v < 1000 THEN CAST(v AS VARCHAR) ELSE regexp_replace(CAST(v // 1000 AS VARCHAR), '(\\d)(\\d\\d)$', CASE WHEN v >= 100000 THEN '\\1,\\2' ELSE '\\1\\2' END) || ',' || lpad(CAST(v % 1000 AS VARCHAR), 3, '0') END || CASE WHEN num % 3 = 0 THEN '' ELSE '.5' END AS price,
  CASE WHEN num % 7 = 0 THEN NULL WHEN num % 7 = 1 THEN 'https://other.example/' || num ELSE 'https://img.shop.example/c/' || num || '.jpg?height=300&width=300' END AS image_url,
  CASE WHEN num % 6 = 0 THEN 'https://shop.example/product-list/all' ELSE 'https://shop.example/product-detail/slug-' || num || '/' || num END AS url,
  CASE WHEN num % 4 < 2 THEN 'slug' ELSE 'named' END AS category
FROM i QUALIFY row_number() OVER (PARTITION BY key ORDER BY num) = 1""",
    ),
    "f12_facet_filter": (lambda s, d: C.facet_filter(C.mapping_status(_p(s, d), _map(s, d)), "unmapped", "Ring").select("id", "name"), f"WITH {_STATUS} SELECT id, name FROM st WHERE NOT mapped AND NOT duplicate AND contains(lower(name), 'ring')"),
    "a10_facet_counts": (
        lambda s, d: C.facet_counts(C.mapping_status(_p(s, d), _map(s, d))),
        f"WITH {_STATUS} SELECT count(*) AS total, count(*) FILTER (attempted) AS attempted, count(*) FILTER (mapped) AS mapped, count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (NOT mapped AND NOT duplicate) AS unmapped FROM st",
    ),
    "j12_mapping_status": (lambda s, d: C.mapping_status(_p(s, d), _map(s, d)), f"WITH {_STATUS} SELECT * FROM st"),
    "j17_known_duplicates": (
        lambda s, d: _map(s, d).select("product_id", F.get_json_object("search_error", "$.duplicate_of").alias("duplicate_of")).where("duplicate_of is not null").join(_p(s, d).select(F.col("id").alias("duplicate_of")), "duplicate_of", "left_semi"),
        "SELECT product_id, json_extract_string(search_error, '$.duplicate_of') AS duplicate_of FROM mappings_v WHERE search_error IS NOT NULL AND json_extract_string(search_error, '$.duplicate_of') IN (SELECT id FROM products_v)",
    ),
    "j1_new_products": (lambda s, d: C.new_products(_snap(s, d), _stored(s, d)).select("item_id", "url"), "SELECT item_id, url FROM snapshot_v WHERE url NOT IN (SELECT url FROM stored_v)"),
    "j2_sync_plan": (lambda s, d: C.sync_plan(_snap(s, d), _stored(s, d)).select("item_id", "url"), "SELECT item_id, url FROM snapshot_v WHERE url NOT IN (SELECT url FROM stored_v) AND item_id NOT IN (SELECT regexp_extract(url, '[^/]+$') FROM stored_v)"),
    "j3_reconcile": (
        lambda s, d: C.reconcile(_stored(s, d), _active(s, d)),
        "SELECT CAST(num AS VARCHAR) AS item_id, 'inactive' AS state FROM stored_v WHERE num % 7 = 0 UNION ALL SELECT item_id, 'missing' FROM snapshot_v WHERE num % 5 = 0",
    ),
    "j4_backfill_images": (
        lambda s, d: C.backfill_images(_p(s, d), _snap(s, d)).select("id", "image_url"),
        f"SELECT p.id, {_ST} AS image_url FROM products_v p LEFT JOIN (SELECT url, arg_max(image_url, num) AS found FROM snapshot_v GROUP BY url) x ON p.url = x.url",
    ),
    "j5_enrich": (
        lambda s, d: C.enrich(_p(s, d), _gate(s, d)),
        "SELECT p.id, coalesce(CASE WHEN CAST(p.price AS BIGINT) > 0 THEN p.price END, NULLIF(g.price, '')) AS price, coalesce(NULLIF(p.mrp_price, ''), CASE WHEN CAST(p.price AS BIGINT) > 0 THEN p.price END, NULLIF(g.price, '')) AS mrp_price, coalesce(p.category, NULLIF(g.category, '')) AS category, coalesce(p.brand, NULLIF(g.brand, '')) AS brand FROM products_v p LEFT JOIN gateway_v g ON p.id = g.id",
    ),
    "j6_merge_detail": (
        lambda s, d: _p(s, d).join(_gate(s, d).select("id", F.col("category").alias("detail")), "id", "left").select("id", F.coalesce(F.nullif("detail", F.lit("")), "category").alias("category"), F.when(F.nullif(F.col("detail"), F.lit("")).isNotNull(), "success").when(F.col("category").isNotNull(), "extracted").otherwise("failed").alias("status")),
        "SELECT p.id, coalesce(NULLIF(g.category, ''), p.category) AS category, CASE WHEN NULLIF(g.category, '') IS NOT NULL THEN 'success' WHEN p.category IS NOT NULL THEN 'extracted' ELSE 'failed' END AS status FROM products_v p LEFT JOIN gateway_v g ON p.id = g.id",
    ),
    "j14_with_cache": (
        lambda s, d: matching.with_cache(_p(s, d).select("id", F.col("name").alias("title"), "image_url"), _p(s, d).where("num % 3 = 0").select(F.col("name").alias("title"), "image_url", F.when(F.col("num") % 2 == 0, F.col("url")).alias("cached_url")).withColumn("cache_key", matching.cache_key()).groupBy("cache_key").agg(F.min("cached_url").alias("cached_url"))).select("id", "cached_url"),
        "WITH k AS (SELECT *, md5(substr(name, 1, 80) || '|' || substr(coalesce(image_url, ''), 1, 120)) AS k FROM products_v), c AS (SELECT k, min(CASE WHEN num % 2 = 0 THEN url END) AS cached_url FROM k WHERE num % 3 = 0 GROUP BY k) SELECT k.id, c.cached_url FROM k LEFT JOIN c ON k.k = c.k",
    ),
    "j16_title_drift": (
        lambda s, d: C.title_drift(_p(s, d), _snap(s, d).select(F.concat(F.lit("p-"), "item_id").alias("id"), F.when(F.col("num") % 2 == 0, F.col("name")).when(F.col("num") % 3 == 0, "").otherwise(F.upper("name")).alias("fresh_title"))),
        "WITH f AS (SELECT concat('p-', item_id) AS id, CASE WHEN num % 2 = 0 THEN name WHEN num % 3 = 0 THEN '' ELSE upper(name) END AS t FROM snapshot_v) SELECT CASE WHEN t IS NULL THEN 'no_page' WHEN t = '' THEN 'error' WHEN t = p.name THEN 'same' ELSE 'updated' END AS outcome, count(*) AS n FROM products_v p LEFT JOIN f ON p.id = f.id GROUP BY 1",
    ),
    "k1_merge_upsert": (
        lambda s, d: K.merge_upsert(_stored(s, d).select("id", "name", "price", "brand"), _updates(s, d), ["id"], ["name", "price"]),
        "WITH u AS (SELECT concat('p-', item_id) AS id, upper(name) AS name, CASE WHEN num % 3 <> 0 THEN '0' END AS price FROM snapshot_v WHERE item_id NOT LIKE '%5') SELECT coalesce(t.id, u.id) AS id, CASE WHEN u.id IS NOT NULL THEN u.name ELSE t.name END AS name, CASE WHEN u.id IS NOT NULL THEN u.price ELSE t.price END AS price, t.brand FROM stored_v t FULL JOIN u ON t.id = u.id",
    ),
    "k2_patch": (
        lambda s, d: K.patch(_stored(s, d).select("id", "name", "price", "brand"), _updates(s, d), "id", ["name", "price"]),
        "WITH u AS (SELECT concat('p-', item_id) AS id, upper(name) AS name, CASE WHEN num % 3 <> 0 THEN '0' END AS price FROM snapshot_v WHERE item_id NOT LIKE '%5') SELECT t.id, coalesce(u.name, t.name) AS name, coalesce(u.price, t.price) AS price, t.brand FROM stored_v t LEFT JOIN u ON t.id = u.id",
    ),
    "k1_stored_upsert": (
        lambda s, d: _changed(s, _stored(s, d).select("id", "name", "price", "brand"), "id", lambda t: t.upsert(_updates(s, d), ["name", "price"])),
        "WITH u AS (SELECT concat('p-', item_id) AS id, upper(name) AS name, CASE WHEN num % 3 <> 0 THEN '0' END AS price FROM snapshot_v WHERE item_id NOT LIKE '%5') SELECT coalesce(t.id, u.id) AS id, CASE WHEN u.id IS NOT NULL THEN u.name ELSE t.name END AS name, CASE WHEN u.id IS NOT NULL THEN u.price ELSE t.price END AS price, t.brand FROM stored_v t FULL JOIN u ON t.id = u.id",
    ),
    "k2_stored_patch": (
        lambda s, d: _changed(s, _stored(s, d).select("id", "name", "price", "brand"), "id", lambda t: t.patch(_updates(s, d), ["name", "price"])),
        "WITH u AS (SELECT concat('p-', item_id) AS id, upper(name) AS name, CASE WHEN num % 3 <> 0 THEN '0' END AS price FROM snapshot_v WHERE item_id NOT LIKE '%5') SELECT t.id, coalesce(u.name, t.name) AS name, coalesce(u.price, t.price) AS price, t.brand FROM stored_v t LEFT JOIN u ON t.id = u.id",
    ),
    "k3_stored_mapping": (
        lambda s, d: _changed(s, _map(s, d).select("product_id", "amazon_url", "flipkart_url"), "product_id", lambda t: t.upsert(_p(s, d).where("num % 9 = 0").select(F.col("id").alias("product_id"), F.col("url").alias("flipkart_url")), ["flipkart_url"])),
        "SELECT coalesce(m.product_id, p.id) AS product_id, m.amazon_url, CASE WHEN p.id IS NOT NULL THEN p.url ELSE m.flipkart_url END AS flipkart_url FROM mappings_v m FULL JOIN (SELECT * FROM products_v WHERE num % 9 = 0) p ON m.product_id = p.id",
    ),
    "k4_stored_delete": (lambda s, d: _changed(s, _p(s, d).select("id", "name"), "id", lambda t: t.delete(_map(s, d).select(F.col("product_id").alias("id")))), "SELECT id, name FROM products_v WHERE id NOT IN (SELECT product_id FROM mappings_v)"),
    "k3_save_mapping": (
        lambda s, d: K.merge_upsert(_map(s, d).select("product_id", "amazon_url", "flipkart_url"), _p(s, d).where("num % 9 = 0").select(F.col("id").alias("product_id"), F.col("url").alias("flipkart_url")), ["product_id"], ["flipkart_url"]),
        "SELECT coalesce(m.product_id, p.id) AS product_id, m.amazon_url, CASE WHEN p.id IS NOT NULL THEN p.url ELSE m.flipkart_url END AS flipkart_url FROM mappings_v m FULL JOIN (SELECT * FROM products_v WHERE num % 9 = 0) p ON m.product_id = p.id",
    ),
    "k4_delete_ids": (lambda s, d: K.delete_ids(_p(s, d), _map(s, d).select(F.col("product_id").alias("id")), "id").select("id"), "SELECT id FROM products_v WHERE id NOT IN (SELECT product_id FROM mappings_v)"),
    "k8_mapping_export": (
        lambda s, d: C.mapping_export(_map(s, d)),
        "SELECT product_id, concat(CAST(CAST(floor(amazon_dinov2 * 100 + 0.5) AS BIGINT) AS VARCHAR), '%') AS similarity, CASE WHEN amazon_unavailable THEN 'Yes' ELSE 'No' END AS unavailable FROM mappings_v",
    ),
    "a11_first_per_key": (lambda s, d: K.first_per_key(_p(s, d).select("name", "num", "id"), ["name"], ["num"]), "SELECT name, min(num) AS num, arg_min(id, num) AS id FROM products_v GROUP BY name"),
    "a12_last_per_key": (lambda s, d: K.last_per_key(_p(s, d).select("name", "num", "id"), ["name"], ["num"]), "SELECT name, max(num) AS num, arg_max(id, num) AS id FROM products_v GROUP BY name"),
    "u1_union_dedup": (
        lambda s, d: K.union_dedup([_stored(s, d).select("id", "num", F.lit("stored").alias("origin")), _p(s, d).select("id", "num", F.lit("all").alias("origin"))], "id", ["num"]),
        "SELECT id, num, CASE WHEN num % 5 <> 0 THEN 'stored' ELSE 'all' END AS origin FROM products_v",
    ),
    "l3_order_by": (lambda s, d: _p(s, d).orderBy("name", "id").limit(100).select("id", "name"), "SELECT id, name FROM products_v ORDER BY name, id LIMIT 100"),
    "l3_groups_by_size": (
        lambda s, d: K.ranked(duplicates.exact_duplicates(_p(s, d)).withColumn("fewer", -F.col("size")), ["fewer", "first_id"]).select("position", "first_id", "size"),
        "SELECT row_number() OVER (ORDER BY count(*) DESC, min(id)) AS position, min(id) AS first_id, count(*) AS size FROM products_v WHERE coalesce(name, '') <> '' AND coalesce(price, '') <> '' AND coalesce(brand, '') <> '' GROUP BY lower(trim(name)), price, lower(trim(brand)) HAVING count(*) > 1",
    ),
    "l3_mappings_by_check": (
        lambda s, d: _map(s, d).withColumn("last_checked", F.when(F.col("num") % 9 != 0, F.col("num") * 7919 % 1000)).orderBy(F.desc_nulls_first("last_checked"), "product_id").limit(200).select("product_id", "last_checked"),
        "SELECT product_id, last_checked FROM (SELECT *, CASE WHEN num % 9 <> 0 THEN num * 7919 % 1000 END AS last_checked FROM mappings_v) ORDER BY last_checked DESC NULLS FIRST, product_id LIMIT 200",
    ),
    "t5_strip_image_proxy": (lambda s, d: _p(s, d).select("id", T.strip_image_proxy(F.col("image_url")).alias("image")), r"SELECT id, regexp_replace(image_url, '^https://resize[.]shop[.]example/V[^/]+/(https?://.*)', '\1') AS image FROM products_v"),
    "t8_url_tail": (lambda s, d: _p(s, d).select("id", T.url_tail(F.concat("url", F.lit("/?x=1"))).alias("tail")), "SELECT id, CAST(num AS VARCHAR) AS tail FROM products_v"),
    "t9_normalize_url_cell": (lambda s, d: _p(s, d).select("id", T.normalize_url_cell(F.when(F.col("num") % 2 == 0, F.col("url")).when(F.col("num") % 3 == 0, " ").otherwise(F.concat(F.lit("/x/"), "id")), "https://shop.example").alias("u")), "SELECT id, CASE WHEN num % 2 = 0 THEN url WHEN num % 3 = 0 THEN NULL ELSE concat('https://shop.example/x/', id) END AS u FROM products_v"),
    "m1_clean_price": (lambda s, d: _p(s, d).select("id", S.clean_price(F.concat(F.lit("Rs "), "price", F.lit(".50/-"))).alias("price")), "SELECT id, CAST(price || '.50' AS DOUBLE) AS price FROM products_v"),
    "m2_price_digits": (lambda s, d: _p(s, d).select("id", S.price_digits(F.concat("price", F.lit(".50"))).alias("digits")), "SELECT id, CAST(price AS BIGINT) * 100 + 50 AS digits FROM products_v"),
    "m3_format_inr": (lambda s, d: _p(s, d).select("id", S.format_inr(F.col("num") * F.col("num") * 7).alias("inr")), f"SELECT id, '₹' || {_GROUPED} AS inr FROM (SELECT id, CAST(num * num * 7 AS VARCHAR) AS n FROM products_v)"),
}


def queries() -> dict:
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: with_views(sql) for k, (_, sql) in Q.items() if sql}
