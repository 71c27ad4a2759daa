"""The library's own tables on top of the test tables, as SQL that Spark and DuckDB both read.

{epoch:x} stands for the seconds since 1970 of a timestamp, which the two write differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF_LOGS, AS_OF_SYNCS = "2024-01-31 00:00:00", "2001-08-02 00:00:00"

VIEWS = {
    "products": (
        ("part",),
        """SELECT p_partkey AS id, CAST(p_partkey AS STRING) AS source_id, p_name AS title, p_type AS category_name, p_brand AS brand,
  p_retailprice AS price_min, p_retailprice * CAST(1.25 AS DOUBLE) AS price_max,
  CASE WHEN p_size % 10 = 0 THEN 'inactive' ELSE 'active' END AS status,
  CASE p_size % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END AS sync_status,
  CAST(p_size % 51 AS DOUBLE) / CAST(10 AS DOUBLE) AS rating, CAST(p_size * 10 AS BIGINT) AS sales_count,
  CASE WHEN p_size % 7 = 0 THEN 'USD' ELSE 'CNY' END AS currency,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE 'https://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg' END AS main_image_url,
  CASE WHEN p_size % 4 <> 0 THEN p_brand || ' ' || p_type END AS description, p_partkey % 110 AS supplier_id
FROM part""",
    ),
    "suppliers": (
        ("supplier", "nation", "region"),
        """SELECT s_suppkey AS id, CAST(s_suppkey AS STRING) AS source_id, s_name AS name, s_name || ' Co' AS company_name,
  '138' || lpad(CAST(s_suppkey % 90 AS STRING), 8, '0') AS phone, CASE WHEN s_suppkey % 6 = 0 THEN 'no mail' ELSE 's' || CAST(s_suppkey AS STRING) || '@example.com' END AS email,
  n_name AS province, r_name AS region, CASE WHEN s_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE least(CAST(5 AS DOUBLE), s_acctbal / CAST(2000 AS DOUBLE)) END AS rating,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Y' ELSE 'N' END AS is_verified, CAST(s_suppkey % 4 * 6 AS BIGINT) AS product_count
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "syncs": (
        ("orders",),
        """SELECT o_orderkey AS id, 'task-' || CAST(o_orderkey % 50 AS STRING) AS task_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
  o_orderpriority AS operation_type, CASE WHEN o_custkey % 2 = 0 THEN 'full' ELSE 'incremental' END AS sync_type, {epoch:o_orderdate} AS start_time,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 500 END AS duration, CAST(100 AS BIGINT) AS total_count, o_orderkey % 105 AS processed_count, o_orderkey % 83 AS success_count,
  o_orderkey % 23 - 1 AS failed_count, o_totalprice AS size
FROM orders""",
    ),
    "logs": (
        ("events",),
        """SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  event_type || ' of user ' || CAST(user_id AS STRING) || ' took ' || CAST(event_id AS STRING) || ' ms' AS message, 'task-' || CAST(user_id % 20 AS STRING) AS task_id,
  user_id, event_type, value AS duration, value, CASE WHEN event_type = 'error' THEN 'E' || CAST(user_id % 7 AS STRING) END AS error_type, props AS details
FROM events""",
    ),
    "images": (
        ("lineitem",),
        """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS product_id, CASE WHEN l_linenumber = 1 THEN 'main' ELSE 'detail' END AS image_type,
  CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'pending' ELSE 'failed' END AS download_status, CAST(l_quantity AS BIGINT) * 1000 AS size, l_linenumber AS sort_order, CAST(l_quantity AS BIGINT) % 5 AS retry_count
FROM lineitem""",
    ),
}
EPOCH = re.compile(r"\{epoch:(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(EPOCH.sub(r"unix_seconds(CAST(\1 AS TIMESTAMP))", sql), **frames)


def with_views(sql: str) -> str:
    """sql for DuckDB with the views that it names."""
    named = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({EPOCH.sub(r'CAST(epoch(\1) AS BIGINT)', VIEWS[n][1])})" for n in named]
    if not ctes:
        return sql
    head = "WITH RECURSIVE" if sql.startswith("WITH RECURSIVE") else "WITH"
    if sql.startswith("WITH"):
        return f"{head} {', '.join(ctes)}, {sql.removeprefix('WITH RECURSIVE').removeprefix('WITH').lstrip()}"
    return f"{head} {', '.join(ctes)} {sql}"
