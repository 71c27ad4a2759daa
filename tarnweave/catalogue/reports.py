"""Lists, reports and records over the library's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, validate
from ..operators import operations as ops
from ..operators import quality, reports, rows
from .operations import ERRORS as ERROR_ROWS
from .operations import errors
from .registry import registry
from .relational import avg
from .views import AS_OF_LOGS

QUERIES, ORACLE_SQL, register = registry()

DAY = f"timestamp BETWEEN TIMESTAMP '{AS_OF_LOGS}' - INTERVAL 24 HOURS AND TIMESTAMP '{AS_OF_LOGS}'"
register("logs_updated_since", lambda t: reports.updated_since(t.view("logs"), "timestamp", AS_OF_LOGS).select("id"), "SELECT id FROM logs WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00'")
register("high_rated_products", lambda t: reports.high_rated(t.view("products")).select("id", "rating"), "SELECT id, rating FROM products WHERE status = 'active' AND rating >= 4 ORDER BY id LIMIT 10")
register("newest_available", lambda t: reports.newest_available(t.view("products"), at="sales_count", n=50, skip=5).select("id", "sales_count"), "SELECT id, sales_count FROM products WHERE status = 'active' AND price_min > 0 ORDER BY sales_count DESC, id LIMIT 50 OFFSET 5")
register("busiest_suppliers", lambda t: reports.busiest_suppliers(t.view("suppliers"), 20).select("id", "product_count"), "SELECT id, product_count FROM suppliers WHERE product_count >= 1 AND rating >= 3.0 ORDER BY product_count DESC, id LIMIT 20")
register("recent_errors", lambda t: reports.recent_errors(t.view("logs"), "2024-01-20").select("id", "level"), "SELECT id, level FROM logs WHERE level IN ('ERROR', 'CRITICAL') AND timestamp >= TIMESTAMP '2024-01-20 00:00:00' ORDER BY timestamp DESC, id DESC LIMIT 20")
register("slow_requests", lambda t: reports.slow_requests(t.view("logs").withColumnRenamed("value", "response_time"), 20.0).select("id", "response_time"), "SELECT id, value AS response_time FROM logs WHERE value >= 20 ORDER BY value DESC, id LIMIT 10")


def counted(source: str, *fields: str) -> str:
    parts = [f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, COUNT(*) AS n FROM {source} GROUP BY 2" for f in fields]
    return " UNION ALL ".join([*parts, f"SELECT 'all', NULL, COUNT(*) FROM {source} HAVING COUNT(*) > 0"])


register(
    "alert_statistics",
    lambda t: reports.alert_statistics(t.view("logs").select(F.lower("level").alias("level"), F.when(F.col("id") % 3 == 0, "resolved").otherwise("active").alias("status"), F.col("task_id").alias("rule_name"), F.col("timestamp").alias("triggered_at")), AS_OF_LOGS, 72),
    f"WITH a AS (SELECT lower(level) AS level, CASE WHEN id % 3 = 0 THEN 'resolved' ELSE 'active' END AS status, task_id AS rule_name FROM logs WHERE timestamp BETWEEN TIMESTAMP '{AS_OF_LOGS}' - INTERVAL 72 HOURS AND TIMESTAMP '{AS_OF_LOGS}') {counted('a', 'level', 'status', 'rule_name')}",
)
tasks = lambda t: t.view("logs").select("id", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("completed").alias("status"), F.col("event_type").alias("queue"), (F.col("user_id") % 4).alias("priority"), F.col("timestamp").alias("finished_at"))
TASKS = "t AS (SELECT id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'completed' END AS status, event_type AS queue, user_id % 4 AS priority, timestamp FROM logs)"
register("task_figures", lambda t: reports.task_figures(tasks(t), AS_OF_LOGS), f"""
WITH {TASKS}, c AS ({counted('t', 'status', 'queue', 'priority')}) SELECT field, value, n, CAST(NULL AS DOUBLE) AS rate FROM c
UNION ALL SELECT 'success_rate', NULL, NULL, coalesce(COUNT(*) FILTER (status = 'completed') / CAST(nullif(COUNT(*), 0) AS DOUBLE), 0) FROM t WHERE status <> 'running' AND {DAY}""")
register("health_trends", lambda t: reports.health_trends(t.view("logs").select("timestamp", "id", F.col("value").alias("error_rate"), (F.col("id") % 97).alias("avg_response_time")), AS_OF_LOGS), f"""
SELECT *, CASE WHEN current > first THEN 'increasing' ELSE 'decreasing' END AS trend FROM (SELECT field, COUNT(*) AS points, arg_max(v, (timestamp, id)) AS current, {avg('v', 6)} AS avg, MAX(v) AS max, MIN(v) AS min, arg_min(v, (timestamp, id)) AS first
  FROM (SELECT timestamp, id, 'error_rate' AS field, value AS v FROM logs UNION ALL SELECT timestamp, id, 'avg_response_time', CAST(id % 97 AS DOUBLE) FROM logs) WHERE {DAY} GROUP BY field)""".replace("SELECT *, CASE", "SELECT field, points, current, avg, max, min, CASE"))
schedules = lambda t: t.view("syncs").select((F.col("id") % 5 > 0).alias("enabled"), (F.col("status") == "running").alias("running"), F.col("sync_type").alias("schedule_type"), F.col("operation_type").alias("queue"), F.col("task_id").alias("batch_id"), F.when(F.col("status") == "completed", "success").otherwise("failure").alias("task_status"))
register("schedule_statistics", lambda t: reports.schedule_statistics(schedules(t)), """
SELECT 'schedule_type' AS field, sync_type AS value, COUNT(*) AS n FROM syncs GROUP BY 2 UNION ALL SELECT 'queue', operation_type, COUNT(*) FROM syncs GROUP BY 2
UNION ALL SELECT 'state', 'enabled', COUNT(*) FILTER (id % 5 > 0) FROM syncs UNION ALL SELECT 'state', 'disabled', COUNT(*) FILTER (id % 5 = 0) FROM syncs UNION ALL SELECT 'state', 'running', COUNT(*) FILTER (status = 'running') FROM syncs UNION ALL SELECT 'state', 'all', COUNT(*) FROM syncs""")
register("batch_schedule_status", lambda t: reports.batch_schedule_status(schedules(t)), """
SELECT *, CAST(floor((completed + failed) * 100 / CAST(total AS DOUBLE)) AS INT) AS progress FROM (SELECT task_id AS batch_id, COUNT(*) AS total, COUNT(*) FILTER (status = 'completed') AS completed, COUNT(*) FILTER (status = 'failed') AS failed, COUNT(*) FILTER (status = 'running') AS running FROM syncs GROUP BY 1)""")
register("duplicate_fields", lambda t: reports.duplicate_fields(t.view("products").groupBy("title").agg(F.array_compact(F.array(*[F.when((F.count_distinct(f) == 1) & (F.count("*") > 1), F.lit(f)) for f in ("brand", "category_name", "currency", "status")])).alias("duplicate_fields"))), """
WITH g AS (SELECT title, COUNT(*) AS n, COUNT(DISTINCT brand) AS b, COUNT(DISTINCT category_name) AS c, COUNT(DISTINCT currency) AS u, COUNT(DISTINCT status) AS s FROM products GROUP BY title HAVING COUNT(*) > 1)
SELECT field, COUNT(*) AS n FROM (SELECT unnest(['brand', 'category_name', 'currency', 'status']) AS field, unnest([b, c, u, s]) AS k FROM g) WHERE k = 1 GROUP BY field""")
register("sync_roll_up", lambda t: reports.sync_roll_up(t.view("products").select("brand", (F.col("sync_status") == "completed").alias("success"), F.when(F.col("description").isNull(), 1).otherwise(0).alias("issues")), "brand"), """
SELECT brand, COUNT(*) AS total, COUNT(*) FILTER (sync_status = 'completed') AS synced, COUNT(*) FILTER (description IS NULL) AS issues, COUNT(*) FILTER (sync_status <> 'completed') AS failed, COUNT(*) FILTER (sync_status = 'completed') * CAST(100 AS DOUBLE) / COUNT(*) AS success_percent FROM products GROUP BY 1""")
register(
    "supplier_quality_report",
    lambda t: reports.supplier_report(t.view("suppliers"), quality.equal_text_pairs(t.view("suppliers"), "phone")).select("metric", F.round("value", 6).alias("value"), "threshold", "level"),
    """WITH s AS (SELECT *, length(name) AS size FROM suppliers), p AS (SELECT CAST(SUM(c * (c - 1) / 2) AS DOUBLE) AS pairs FROM (SELECT COUNT(*) AS c FROM suppliers GROUP BY phone)),
m AS (SELECT 'completeness' AS metric, CAST(0.5 + 0.3 * 2 / 3 + 0.2 * 1 / 4 AS DOUBLE) AS value, CAST(0.80 AS DOUBLE) AS threshold, CAST(0.3 AS DOUBLE) AS w UNION ALL SELECT 'accuracy', 1, 0.9, 0.25
  UNION ALL SELECT 'validity', COUNT(*) FILTER (email LIKE '%@%') / CAST(COUNT(*) AS DOUBLE), 0.95, 0.2 FROM s
  UNION ALL SELECT 'consistency', greatest(0, least(1, 0.2 * (1 - least(coalesce(stddev_samp(size) / avg(size), 0), 1)) - 0.3 * MAX(pairs) / COUNT(*))), 0.85, 0.15 FROM s, p
  UNION ALL SELECT 'uniqueness', ((2 * COUNT(DISTINCT source_id) - COUNT(source_id)) / CAST(COUNT(*) AS DOUBLE) + (2 * COUNT(DISTINCT name) - COUNT(name)) / CAST(COUNT(*) AS DOUBLE)) / 2, 0.95, 0.1 FROM s),
a AS (SELECT metric, value, threshold FROM m UNION ALL SELECT 'overall', SUM(value * w) / SUM(w), 0.8 FROM m)
SELECT metric, round(value, 6) AS value, threshold, CASE WHEN value >= 0.9 THEN 'excellent' WHEN value >= threshold THEN 'good' WHEN value >= threshold - 0.1 THEN 'fair' WHEN value >= threshold - 0.2 THEN 'poor' ELSE 'critical' END AS level FROM a""",
)
register("marked_processed", lambda t: reports.mark_processed(t.view("products").select("source_id", "sync_status"), t.view("products").where("id % 4 = 0").select("source_id", F.when(F.col("id") % 8 == 0, "success").otherwise("failed").alias("status"))), "SELECT source_id, CASE WHEN id % 8 = 0 THEN 'processed' ELSE sync_status END AS sync_status, id % 8 = 0 AS marked FROM products")
register(
    "job_records",
    lambda t: reports.job_record(t.view("products").agg(F.count("*").alias("total"), F.count_if(F.col("sync_status") == "failed").alias("failed")), "products_import", "batch_import", "full", "2024-01-30", AS_OF_LOGS).select("entity_type", "status", "result_data"),
    """SELECT 'products_import' AS entity_type, 'completed' AS status, '{"failed":' || COUNT(*) FILTER (sync_status = 'failed') || ',"total":' || COUNT(*) || '}' AS result_data FROM products""",
)
register("error_rule_minutes", lambda t: ops.error_rule(errors(t), "2024-01-30 12:00:00", 1800, 1), f"WITH {ERROR_ROWS} SELECT COUNT(*) AS n, COUNT(*) >= 1 AS firing FROM errors WHERE epoch(date_trunc('second', timestamp)) BETWEEN epoch(TIMESTAMP '2024-01-30 12:00:00') - 1800 AND epoch(TIMESTAMP '2024-01-30 12:00:00')")
register("updated_by_newest", lambda t: rows.updated_from(t.view("suppliers").select("id", "name"), t.view("products").select(F.col("supplier_id").alias("id"), F.col("title").alias("name"), F.col("id").alias("at")), "id", AS_OF_LOGS, order="at").select("id", "name"), """
SELECT s.id, coalesce(p.name, s.name) AS name FROM suppliers s LEFT JOIN (SELECT supplier_id, arg_max(title, id) AS name FROM products GROUP BY 1) p ON p.supplier_id = s.id""")
raw_suppliers = lambda t: t.view("suppliers").select("source_id", F.concat(F.lit("  "), F.col("name")).alias("name"), "phone", "email", "province", F.col("company_name"), F.lit("").alias("city"))
register("supplier_blocks", lambda t: clean.supplier_blocks(clean.clean_suppliers(raw_suppliers(t))).select("source_id", "name", F.try_element_at("contact_info", F.lit("phone")).alias("phone"), F.try_element_at("contact_info", F.lit("email")).alias("email"), F.size("address_info").alias("address_fields"), F.try_element_at("business_info", F.lit("company_name")).alias("company_name")), """
SELECT source_id, replace(name, '#', '') AS name, phone, CASE WHEN email LIKE '%@%' THEN email END AS email, 1 AS address_fields, replace(company_name, '#', '') AS company_name FROM suppliers""")
register("attributes_put", lambda t: t.view("products").select("id", clean.put(clean.put(F.create_map(F.lit("brand"), F.col("brand")), "brand", F.lit("none")), "status", F.col("status")).alias("a")).select("id", F.col("a")["brand"].alias("brand"), F.col("a")["status"].alias("status"), F.size("a").alias("n")), "SELECT id, 'none' AS brand, status, 2 AS n FROM products")
register("bad_image_positions", lambda t: validate.validate_products(t.view("products").select("source_id", "title", F.array(F.lit("https://a.example/x.jpg"), F.lit("no url"), F.when(F.col("id") % 2 == 0, "https://a.example/y.jpg"), F.col("main_image_url")).alias("detail_images"))).select("source_id", F.get(F.filter("validation", lambda v: v["field"] == "detail_images"), F.lit(0))["message"].alias("message")), """
SELECT source_id, 'not a URL at 1' || CASE WHEN id % 2 = 1 THEN ', 2' ELSE '' END || CASE WHEN main_image_url = '' THEN ', 3' ELSE '' END AS message FROM products""")
