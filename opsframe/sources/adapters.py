"""The driver's tables as products, snapshots, checks, candidates and videos. The SQL runs in Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsframe.sources.readers import scan

_PRODUCTS = """SELECT concat('p-', CAST(p_partkey AS STRING)) AS id, p_partkey AS num, p_name AS name,
  concat('https://shop.example/product-detail/', replace(p_name,' ','-'), '/', CAST(p_partkey AS STRING)) AS url,
  CASE WHEN p_partkey % 4 = 0 THEN NULL
       WHEN p_partkey % 4 = 1 THEN concat('https://resize.shop.example/V1/https://cdn.shop.example/', CAST(p_partkey AS STRING), '.jpg')
       ELSE concat('https://cdn.shop.example/', CAST(p_partkey AS STRING), '.jpg') END AS image_url,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(CAST(floor(p_retailprice / 100) * 100 AS BIGINT) AS STRING) END AS price,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(CAST(floor(p_retailprice / 100) * 120 AS BIGINT) AS STRING) END AS mrp_price,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS category,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_brand END AS brand
FROM {part}"""

SQL = {
    "products_v": _PRODUCTS,
    "stored_v": f"SELECT * FROM ({_PRODUCTS}) WHERE num % 5 <> 0",
    "snapshot_v": """SELECT CAST(p_partkey AS STRING) AS item_id, p_partkey AS num,
  concat('https://shop.example/product-detail/', replace(p_name,' ','-'), '/', CAST(p_partkey AS STRING)) AS url, p_name AS name,
  concat('https://resize.shop.example/V1/https://cdn.shop.example/', CAST(p_partkey AS STRING), '.jpg') AS image_url
FROM {part} WHERE p_partkey % 7 <> 0""",
    "gateway_v": """SELECT concat('p-', CAST(p_partkey AS STRING)) AS id,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size * 10 AS STRING) END AS price,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_type END AS category, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE upper(p_brand) END AS brand
FROM {part} WHERE p_partkey % 2 = 0""",
    "check_results_v": """SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS run_at,
  CASE WHEN user_id % 2 = 0 THEN NULL ELSE concat('run-', CAST(extract(day FROM ts) AS STRING), '-', CAST(extract(hour FROM ts) AS STRING)) END AS run_id,
  CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'happy_flow' WHEN 'purchase' THEN 'api/checkout'
                  WHEN 'signup' THEN 'server/auth' ELSE 'feature/home' END AS page,
  concat('metric_', CAST(user_id % 5 AS STRING)) AS metric, value,
  CASE WHEN value >= 300 THEN 'unknown'
       WHEN value < CASE event_type WHEN 'view' THEN 150 WHEN 'signup' THEN 25 ELSE 40 END THEN 'pass'
       WHEN value < CASE event_type WHEN 'view' THEN 200 WHEN 'signup' THEN 50 ELSE 80 END THEN 'degraded'
       ELSE 'fail' END AS status,
  CASE WHEN value >= 80 THEN concat('slow: ', event_type) ELSE NULL END AS step_failed,
  CAST(floor(value * 100) AS INT) AS duration_ms
FROM {events}""",
    "candidates_v": """SELECT q.p_partkey AS product_key, q.p_name AS title, CAST(q.p_retailprice AS STRING) AS price,
  CASE c.p_partkey % 3 WHEN 0 THEN 'amazon' WHEN 1 THEN 'flipkart' ELSE 'meesho' END AS platform,
  CASE WHEN c.p_partkey % 5 = 0 THEN 'revimg' ELSE 'search' END AS source,
  c.p_partkey AS cand_key, concat('https://', CASE c.p_partkey % 3 WHEN 0 THEN 'www.amazon.in/dp/' WHEN 1 THEN 'www.flipkart.com/x/p/' ELSE 'www.meesho.com/x/p/' END, CAST(c.p_partkey AS STRING)) AS cand_url, concat(c.p_name, ' ', lower(c.p_type), ' pack of 2') AS cand_title,
  CASE WHEN c.p_partkey % 23 = 0 THEN NULL ELSE CAST(c.p_retailprice AS STRING) END AS cand_price,
  (q.p_partkey * 2654435761) % 1048576 AS phash, (c.p_partkey * 2654435761) % 1048576 AS cand_phash,
  CAST((q.p_partkey * 31 + c.p_partkey * 17) % 101 AS DOUBLE) / 100 AS dinov2_sim,
  CAST((q.p_partkey * 13 + c.p_partkey * 29) % 101 AS DOUBLE) / 100 AS clip_sim,
  concat('https://cdn.shop.example/i/', CAST(q.p_partkey AS STRING), '_512.jpg?x') AS image_url,
  concat('https://cdn.shop.example/i/', CAST(CASE WHEN c.p_partkey % 6 = 0 THEN q.p_partkey ELSE c.p_partkey END AS STRING), '_256.jpg') AS cand_image
FROM {part} q JOIN {part} c ON q.p_brand = c.p_brand AND q.p_partkey <> c.p_partkey AND CAST(floor(q.p_partkey / 400.0) AS BIGINT) = CAST(floor(c.p_partkey / 400.0) AS BIGINT)""",
    "videos_v": """SELECT concat('yt-', CAST(c.p_partkey % 400 AS STRING)) AS id, q.p_partkey AS product_key, q.p_name AS product_name,
  c.p_partkey AS seq, CASE c.p_partkey % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'instagram' ELSE 'facebook' END AS platform, concat(c.p_name, ' ', lower(c.p_type), ' review!') AS title,
  CASE WHEN c.p_partkey % 8 = 0 THEN NULL ELSE concat(CAST(c.p_partkey % 2 AS STRING), ':', lpad(CAST(c.p_size % 60 AS STRING), 2, '0')) END AS duration,
  CASE WHEN c.p_partkey % 9 = 0 THEN NULL ELSE CAST(c.p_size AS BIGINT) * 1000 END AS view_count
FROM {part} q JOIN {part} c ON q.p_brand = c.p_brand AND q.p_partkey <> c.p_partkey AND CAST(floor(q.p_partkey / 400.0) AS BIGINT) = CAST(floor(c.p_partkey / 400.0) AS BIGINT)""",
    "mappings_v": """SELECT p_partkey AS num, concat('p-', CAST(p_partkey AS STRING)) AS product_id,
  CASE WHEN p_partkey % 3 = 0 THEN concat('https://www.amazon.in/dp/', lpad(CAST(p_partkey AS STRING), 10, 'B')) END AS amazon_url,
  CASE WHEN p_partkey % 4 = 0 THEN concat('https://www.flipkart.com/x?pid=', CAST(p_partkey AS STRING)) END AS flipkart_url,
  CASE WHEN p_partkey % 7 = 0 THEN concat('{{"duplicate_of": "p-', CAST(p_partkey - 7 AS STRING), '"}}') END AS search_error,
  CAST(p_size AS DOUBLE) * 2 AS amazon_match_score, CAST(p_size % 50 AS DOUBLE) / 50 AS amazon_dinov2, p_size % 6 = 0 AS amazon_unavailable
FROM {part} WHERE p_partkey % 2 = 0 OR p_partkey % 7 = 0""",
}
_TABLES = {"products_v": ["part"], "stored_v": ["part"], "snapshot_v": ["part"], "gateway_v": ["part"], "check_results_v": ["events"], "candidates_v": ["part"], "videos_v": ["part"], "mappings_v": ["part"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(SQL[name], **{t: scan(spark, sf_dir, t) for t in _TABLES[name]})


def with_views(sql: str) -> str:
    """DuckDB SQL with the adapters it names in front."""
    own = [f"{n} AS ({s.format(part='part', events='events')})" for n, s in SQL.items() if n in sql]
    body = sql.strip()
    if not own:
        return body
    return f"WITH {', '.join(own)}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"
