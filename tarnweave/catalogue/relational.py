"""Lists, searches, statistics and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.model import is_available, price_range_text
from ..operators import consistency as con
from ..operators import predicates as pred
from ..operators import statistics as st
from .registry import registry
from .views import AS_OF_LOGS, AS_OF_SYNCS

QUERIES, ORACLE_SQL, register = registry()

SUM = "CAST(SUM(CAST({0} AS DECIMAL(18,{1}))) AS DOUBLE)"
AVG = "CAST(SUM(CAST({0} AS DECIMAL(18,{1}))) AS DOUBLE) / COUNT({0})"


def avg(c: str, scale: int = 2) -> str:
    return AVG.format(c, scale)


def supplier_product_summary(t):
    """Suppliers that sold parts, with their parts, prices and sales."""
    sold = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("long").alias("sales_count"))
    products = sold.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("supplier_id"), F.col("p_retailprice").alias("price_min"), F.col("p_retailprice").alias("price_max"), "sales_count", (F.col("p_size") % 51).cast("double").alias("rating"))
    return st.supplier_product_summary(products).join(t.supplier, F.col("supplier_id") == F.col("s_suppkey")).select("supplier_id", "s_name", "product_count", "min_price", "max_price", "avg_price", "total_sales", "avg_rating")


register("supplier_product_summary", supplier_product_summary, f"""
WITH sold AS (SELECT l_suppkey, l_partkey, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS BIGINT) AS sales FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey AS supplier_id, s_name, COUNT(*) AS product_count, MIN(p_retailprice) AS min_price, MAX(p_retailprice) AS max_price, {avg('p_retailprice')} AS avg_price,
  CAST(SUM(sales) AS BIGINT) AS total_sales, {avg('p_size % 51')} AS avg_rating
FROM sold JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")

register("product_statistics_by_category", lambda t: st.price_statistics(t.view("products"), "category_name"),
         f"SELECT category_name, COUNT(*) AS n, MIN(price_min) AS min_price, MAX(price_max) AS max_price, {avg('price_min')} AS avg_price FROM products WHERE price_min IS NOT NULL GROUP BY 1")
register("product_overview", lambda t: st.product_overview(t.view("products"), AS_OF_LOGS), """
SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'active') AS active, COUNT(*) FILTER (status <> 'active') AS inactive, COUNT(*) FILTER (sync_status = 'pending') AS pending,
  COUNT(*) FILTER (sync_status = 'failed') AS failed, CAST(0 AS BIGINT) AS recent FROM products""")
register("products_by_status", lambda t: st.distribution(t.view("products"), "status", "sync_status"), "SELECT status, sync_status, COUNT(*) AS n FROM products GROUP BY 1, 2")
register("supplier_statistics_by_region", lambda t: st.supplier_statistics(t.view("suppliers"), "region", "province"), """
SELECT region, province, COUNT(*) AS total, COUNT(*) FILTER (is_verified = 'Y') AS verified, COUNT(*) FILTER (is_verified = 'Y') * CAST(100 AS DOUBLE) / COUNT(*) AS verified_percent FROM suppliers GROUP BY 1, 2""")
register("top_suppliers_by_product_count", lambda t: st.top(t.lineitem.select("l_suppkey", "l_partkey").distinct().groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n")).join(t.view("suppliers").select("id", "name"), "id"), "n", 10, "id"), """
SELECT id, n, name FROM (SELECT l_suppkey AS id, COUNT(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) JOIN (SELECT id, name FROM suppliers) USING (id) ORDER BY n DESC, id LIMIT 10""")
register("hot_products", lambda t: st.top(t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(st.exact_sum("l_quantity").alias("sales")).join(t.view("products").select("id", "title"), "id"), "sales", 20, "id"), f"""
SELECT id, sales, title FROM (SELECT l_partkey AS id, {SUM.format('l_quantity', 2)} AS sales FROM lineitem GROUP BY 1) JOIN (SELECT id, title FROM products) USING (id) ORDER BY sales DESC, id LIMIT 20""")
register("image_statistics", lambda t: st.image_statistics(t.view("images"), "image_type", "download_status"), """
SELECT image_type, download_status, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS bytes, COUNT(*) FILTER (image_type = 'main') AS main_images, COUNT(*) FILTER (download_status = 'completed') AS downloaded, COUNT(*) FILTER (download_status = 'failed') AS failed FROM images GROUP BY 1, 2""")
register("image_summary_by_product", lambda t: st.image_statistics(t.view("images"), "product_id"), """
SELECT product_id, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS bytes, COUNT(*) FILTER (image_type = 'main') AS main_images, COUNT(*) FILTER (download_status = 'completed') AS downloaded, COUNT(*) FILTER (download_status = 'failed') AS failed FROM images GROUP BY 1""")
register("main_image_of_product", lambda t: st.rank_within(t.view("images"), ["product_id"], [F.asc("sort_order"), F.asc("id")], 1).select("product_id", "id", "sort_order"), """
SELECT product_id, id, sort_order FROM images QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY sort_order, id) = 1""")

PRICED = {"price_min": {"gte": 950, "lt": 1100}, "category_name": {"in": ["ECONOMY", "SMALL", "PROMO"]}, "title": {"like": "%ring%"}, "brand": {"ne": "Brand#2"}}
register("predicate_dsl_ops", lambda t: pred.find(t.view("products"), PRICED).select("id", "title", "price_min"), """
SELECT id, title, price_min FROM products WHERE price_min >= 950 AND price_min < 1100 AND category_name IN ('ECONOMY', 'SMALL', 'PROMO') AND title LIKE '%ring%' AND brand <> 'Brand#2'""")
register("predicate_dsl_strict", lambda t: pred.find(t.view("products"), {"price_min": {"gte": 1500, "lte": 1600}}, strict_reference=True).agg(F.count("*").alias("n")), "SELECT COUNT(*) AS n FROM products WHERE price_min >= 1500")
register("product_search_like", lambda t: pred.search_products(t.view("products"), keyword="widget", price=(900, 1500), rating=(1.0, None), status="active").select("id", "title", "rating"), """
SELECT id, title, rating FROM products WHERE title LIKE '%widget%' AND price_min BETWEEN 900 AND 1500 AND rating >= 1 AND status = 'active'""")
register("product_search_ilike_or", lambda t: t.view("products").where(pred.contains_any(["title", "description", "category_name", "source_id"], "SMALL")).select("id", "title"), """
SELECT id, title FROM products WHERE title ILIKE '%small%' OR coalesce(description ILIKE '%small%', false) OR category_name ILIKE '%small%' OR source_id ILIKE '%small%'""")
register("paged_list_desc", lambda t: pred.page(t.view("syncs"), "start_time", skip=100, limit=50).select("id", "task_id", "start_time"), "SELECT id, task_id, start_time FROM syncs ORDER BY start_time DESC NULLS FIRST, id LIMIT 50 OFFSET 100")
register("available_products", lambda t: pred.available_products(t.view("products")).select("id", price_range_text(F.col("price_min"), F.col("price_min") + 10).alias("price_text"), is_available(F.col("status"), F.col("price_min")).alias("available")), """
SELECT id, printf('%.2f', price_min) || '-' || printf('%.2f', price_min + 10) AS price_text, true AS available FROM products WHERE status = 'active' AND price_min > 0""")
register("supplier_search", lambda t: pred.search_suppliers(t.view("suppliers"), keyword="000001", rating=(1.0, 4.5)).select("id", "name", "rating"), "SELECT id, name, rating FROM suppliers WHERE name ILIKE '%000001%' AND rating BETWEEN 1 AND 4.5")
register("active_suppliers", lambda t: pred.active_suppliers(t.view("suppliers")).select("id", "product_count", "rating"), "SELECT id, product_count, rating FROM suppliers WHERE product_count >= 1 AND rating >= 3")

SYNC = f"""COUNT(*) AS total, COUNT(*) FILTER (status = 'completed') AS completed, COUNT(*) FILTER (status = 'failed') AS failed, COUNT(*) FILTER (status = 'running') AS running,
  MIN(duration) AS min_duration, MAX(duration) AS max_duration, {avg('duration')} AS avg_duration, CAST(SUM(processed_count) AS BIGINT) AS processed, CAST(SUM(success_count) AS BIGINT) AS succeeded,
  CASE WHEN SUM(processed_count) > 0 THEN CAST(SUM(success_count) * 100 AS DOUBLE) / CAST(SUM(processed_count) AS DOUBLE) ELSE 0 END AS success_rate"""
register("sync_statistics", lambda t: st.sync_statistics(t.view("syncs"), "sync_type", "operation_type"), f"SELECT sync_type, operation_type, {SYNC} FROM syncs GROUP BY 1, 2")
DAILY = """SELECT d AS days_ago, COUNT(id) AS total, COUNT(*) FILTER (status = 'completed') AS completed, COUNT(*) FILTER (status = 'failed') AS failed, CAST(coalesce(SUM(processed_count), 0) AS BIGINT) AS processed
FROM (SELECT unnest(range(30)) AS d) LEFT JOIN syncs ON d = {0} GROUP BY 1"""
register("sync_daily_rolling", lambda t: st.daily_summary(t.view("syncs"), AS_OF_SYNCS, 30), DAILY.format(f"CAST(floor((CAST(epoch(TIMESTAMP '{AS_OF_SYNCS}') AS BIGINT) - start_time) / 86400.0) AS BIGINT)"))
register("sync_daily_calendar", lambda t: st.daily_summary(t.view("syncs"), "2001-08-01 12:00:00", 30, rolling=False), DAILY.format("date_diff('day', CAST(to_timestamp(start_time) AT TIME ZONE 'UTC' AS DATE), DATE '2001-08-01')"))
register("task_statistics", lambda t: st.task_statistics(t.view("syncs").withColumnRenamed("operation_type", "task_type")), f"""
SELECT operation_type AS task_type, COUNT(*) AS total, COUNT(*) FILTER (status = 'completed') AS completed, COUNT(*) FILTER (status = 'failed') AS failed, {avg('duration')} AS avg_duration,
  COUNT(*) FILTER (status = 'completed') * CAST(100 AS DOUBLE) / COUNT(*) FILTER (status IN ('completed', 'failed')) AS success_percent FROM syncs GROUP BY 1""")
register("task_status_dense", lambda t: st.dense_counts(t.view("syncs"), "status", ("pending", "running", "completed", "failed", "cancelled")), """
SELECT status, COUNT(id) AS n FROM (SELECT unnest(['pending', 'running', 'completed', 'failed', 'cancelled']) AS status) LEFT JOIN syncs USING (status) GROUP BY 1""")
register("progress_summary", lambda t: st.progress_summary(t.view("syncs").select("status", F.when(F.col("id") % 9 != 0, F.col("processed_count")).alias("percent"))), """
SELECT status, COUNT(*) AS n, CAST(SUM(CASE WHEN id % 9 <> 0 THEN processed_count ELSE 0 END) AS DOUBLE) / COUNT(*) AS avg_percent FROM syncs GROUP BY 1""")

register("log_statistics", lambda t: st.log_statistics(t.view("logs"), AS_OF_LOGS), f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (level = 'DEBUG') AS debug, COUNT(*) FILTER (level = 'INFO') AS info, COUNT(*) FILTER (level = 'WARNING') AS warning, COUNT(*) FILTER (level = 'ERROR') AS error, COUNT(*) FILTER (level = 'CRITICAL') AS critical,
  {avg('duration', 6)} AS avg_duration, COUNT(*) FILTER (level IN ('ERROR', 'CRITICAL') AND timestamp >= TIMESTAMP '2024-01-30 00:00:00') AS recent_errors, COUNT(*) FILTER (level IN ('ERROR', 'CRITICAL')) * CAST(100 AS DOUBLE) / COUNT(*) AS error_percent FROM logs""")
register("log_level_counts_dense", lambda t: st.dense_counts(t.view("logs"), "level", st.LEVELS), "SELECT level, COUNT(id) AS n FROM (SELECT unnest(['DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL']) AS level) LEFT JOIN logs USING (level) GROUP BY 1")
register("log_error_summary_topk", lambda t: st.error_summary(t.view("logs"), "error_type"), "SELECT error_type, COUNT(*) AS n FROM logs WHERE level = 'ERROR' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
register("log_tasks_with_errors", lambda t: st.error_summary(t.view("logs"), "task_id"), "SELECT task_id, COUNT(*) AS n FROM logs WHERE level = 'ERROR' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
register("log_search", lambda t: pred.search_logs(t.view("logs"), text="USER 7", levels=["ERROR", "WARNING"], since="2024-01-05", until="2024-01-25").select("id", "level", "message"), """
SELECT id, level, message FROM logs WHERE (message ILIKE '%user 7%' OR details ILIKE '%user 7%') AND level IN ('ERROR', 'WARNING') AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""")
for unit in ("hour", "day", "week", "month"):
    register(f"log_buckets_{unit}", lambda t, unit=unit: st.time_buckets(t.view("logs"), unit), f"SELECT strftime(date_trunc('{unit}', timestamp), '%Y-%m-%d %H:%M:%S') AS bucket, COUNT(*) AS n, COUNT(*) FILTER (level = 'ERROR') AS errors FROM logs GROUP BY 1")

register("orphans_anti_join", lambda t: con.orphans(t.orders, "o_orderkey", t.lineitem, "l_orderkey").select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
register("orphan_products", lambda t: con.orphans(t.view("products"), "supplier_id", t.view("suppliers"), "id").select("id", "supplier_id"), "SELECT id, supplier_id FROM products WHERE supplier_id NOT IN (SELECT id FROM suppliers)")
register("missing_main_image", lambda t: con.without_main_image(t.view("products"), t.view("images")).select("id"), "SELECT id FROM products WHERE status = 'active' AND id NOT IN (SELECT product_id FROM images WHERE image_type = 'main')")
MISMATCH = "SELECT s.id, product_count, coalesce(n, 0) AS actual FROM (SELECT id, product_count FROM suppliers) s LEFT JOIN (SELECT supplier_id, COUNT(*) AS n FROM products GROUP BY 1) p ON s.id = p.supplier_id"
register("count_mismatch_outer_join", lambda t: con.count_mismatches(t.view("suppliers"), t.view("products")), f"SELECT * FROM ({MISMATCH}) WHERE product_count <> actual")
register("fix_product_counts", lambda t: con.fix_counts(t.view("suppliers"), t.view("products")).select("id", "product_count"), f"SELECT id, actual AS product_count FROM ({MISMATCH})")
register("fk_violations", lambda t: con.foreign_key_violations([("orders_customer", t.orders, "o_custkey", t.customer, "c_custkey"), ("lineitem_orders", t.lineitem, "l_orderkey", t.orders, "o_orderkey"), ("lineitem_part", t.lineitem, "l_partkey", t.part, "p_partkey"), ("products_suppliers", t.view("products"), "supplier_id", t.view("suppliers"), "id")]), """
SELECT 'orders_customer' AS name, COUNT(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem_orders', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem_part', COUNT(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'products_suppliers', COUNT(*) FROM products WHERE supplier_id NOT IN (SELECT id FROM suppliers)""")
register("duplicate_keys_having", lambda t: con.duplicate_keys(t.view("products"), "title", "category_name"), "SELECT title, category_name, COUNT(*) AS n FROM products GROUP BY 1, 2 HAVING COUNT(*) > 1")
register("duplicate_groups_members", lambda t: con.duplicate_members(t.view("products"), ["title", "brand"], ["id"]).select("id", "group_size", "place"), """
SELECT * FROM (SELECT id, COUNT(*) OVER (PARTITION BY title, brand) AS group_size, CAST(row_number() OVER (PARTITION BY title, brand ORDER BY id) AS INT) AS place FROM products) WHERE group_size > 1""")
BAD = f"""SELECT id, CASE WHEN processed_count < 0 OR success_count < 0 OR failed_count < 0 THEN 'negative' WHEN processed_count > total_count THEN 'too_many'
  WHEN status = 'running' AND CAST(epoch(TIMESTAMP '{AS_OF_SYNCS}') AS BIGINT) - start_time > 86400 THEN 'long_running' END AS reason FROM syncs"""
register("inconsistent_syncs", lambda t: con.inconsistent_syncs(t.view("syncs"), AS_OF_SYNCS).select("id", "reason"), f"SELECT * FROM ({BAD}) WHERE reason IS NOT NULL")
register("integrity_report", lambda t: con.integrity_report({"orphan_products": con.orphans(t.view("products"), "supplier_id", t.view("suppliers"), "id"), "count_mismatches": con.count_mismatches(t.view("suppliers"), t.view("products")), "missing_main_image": con.without_main_image(t.view("products"), t.view("images")), "inconsistent_syncs": con.inconsistent_syncs(t.view("syncs"), AS_OF_SYNCS)}), f"""
SELECT * FROM (SELECT 'orphan_products' AS kind, COUNT(*) AS n, 'high' AS priority FROM products WHERE supplier_id NOT IN (SELECT id FROM suppliers)
UNION ALL SELECT 'count_mismatches', COUNT(*), 'medium' FROM ({MISMATCH}) WHERE product_count <> actual
UNION ALL SELECT 'missing_main_image', COUNT(*), 'medium' FROM products WHERE status = 'active' AND id NOT IN (SELECT product_id FROM images WHERE image_type = 'main')
UNION ALL SELECT 'inconsistent_syncs', COUNT(*), 'low' FROM ({BAD}) WHERE reason IS NOT NULL) WHERE n > 0""")
