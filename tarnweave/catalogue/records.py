"""Duplicates, versions, snapshots and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, quality, tables, versions
from .registry import registry
from .views import AS_OF_LOGS

QUERIES, ORACLE_SQL, register = registry()


def updates(t):
    """Every third product at a new price, and as many new products."""
    changed = t.view("products").where("id % 3 = 0").select("id", F.concat("title", F.lit(" new")).alias("title"), (F.col("price_min") + 1).alias("price_min"))
    return changed.unionByName(changed.withColumn("id", F.col("id") + 10_000_000))


UPDATES = "(SELECT id, title || ' new' AS title, price_min + 1 AS price_min FROM products WHERE id % 3 = 0 UNION ALL SELECT id + 10000000, title || ' new', price_min + 1 FROM products WHERE id % 3 = 0)"
base = lambda t: t.view("products").select("id", "title", "price_min")
register("upsert_snapshot", lambda t: tables.upsert(base(t), updates(t), ["id"], "price_min"), f"SELECT * FROM {UPDATES} UNION ALL SELECT id, title, price_min FROM products WHERE id % 3 <> 0")
register("insert_missing", lambda t: tables.insert_missing(base(t), updates(t), ["id"]), f"SELECT id, title, price_min FROM products UNION ALL SELECT * FROM {UPDATES} WHERE id >= 10000000")
register("coalescing_upsert", lambda t: tables.coalescing_upsert(base(t), t.view("products").where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "").otherwise("x").alias("title"), F.lit(None).cast("double").alias("price_min")), "id"), """
SELECT id, CASE WHEN id % 4 = 2 THEN 'x' ELSE title END AS title, price_min FROM products""")
register("update_by_key", lambda t: tables.update_by_key(base(t), updates(t), "id"), "SELECT id, CASE WHEN id % 3 = 0 THEN title || ' new' ELSE title END AS title, CASE WHEN id % 3 = 0 THEN price_min + 1 ELSE price_min END AS price_min FROM products")
register("update_where", lambda t: tables.update_where(t.view("products"), F.col("sync_status") == "failed", {"sync_status": "pending"}).groupBy("sync_status").agg(F.count("*").alias("n")), "SELECT CASE WHEN sync_status = 'failed' THEN 'pending' ELSE sync_status END AS sync_status, COUNT(*) AS n FROM products GROUP BY 1")
register("delete_keys", lambda t: tables.delete_keys(base(t), t.view("products").where("status = 'inactive'").select("id"), "id", confirm=True), "SELECT id, title, price_min FROM products WHERE status <> 'inactive'")
register("retention_filter", lambda t: tables.retain(t.view("logs"), "timestamp", AS_OF_LOGS, 7, F.col("level") == "ERROR").select("id", "level"), "SELECT id, level FROM logs WHERE timestamp >= TIMESTAMP '2024-01-24 00:00:00' OR level = 'ERROR'")
register("retry_failed_images", lambda t: tables.retry_failed(t.view("images")).select("id", "retry_count", "download_status"), "SELECT id, retry_count, 'pending' AS download_status FROM images WHERE download_status = 'failed' AND retry_count < 3 ORDER BY retry_count, id LIMIT 100")
register("image_status_update", lambda t: tables.set_image_status(t.view("images"), t.view("images").where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, "failed").otherwise("completed").alias("download_status"))).groupBy("download_status").agg(F.count("*").alias("n"), F.sum("retry_count").alias("retries")), """
SELECT CASE WHEN id % 6 = 0 THEN 'failed' WHEN id % 2 = 0 THEN 'completed' ELSE download_status END AS download_status, COUNT(*) AS n, CAST(SUM(retry_count + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS retries FROM images GROUP BY 1""")
register("state_transition", lambda t: tables.transition(t.view("syncs").select("id", "status"), t.view("syncs").select("id", F.lit("completed").alias("status")), "id").groupBy("status", "accepted").agg(F.count("*").alias("n")), """
SELECT CASE WHEN status = 'running' THEN 'completed' ELSE status END AS status, status = 'running' AS accepted, COUNT(*) AS n FROM syncs GROUP BY 1, 2""")
register("latest_state_by_user", lambda t: tables.latest_state(t.view("logs").select("user_id", "id", "timestamp", "level"), "user_id", "timestamp").select("user_id", "id", "level"), "SELECT user_id, id, level FROM logs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) = 1")
register("newest_per_task", lambda t: tables.newest(t.view("logs"), ["task_id"], "timestamp", 100, "id").select("task_id", "id", "place"), "SELECT task_id, id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY timestamp DESC, id DESC) AS INT) AS place FROM logs QUALIFY place <= 100")
register("batch_numbers", lambda t: tables.batch_numbers(t.view("products").select("id"), "id", 64), "SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 64) AS BIGINT) AS batch FROM products")
register("resumable_tasks", lambda t: tables.resumable(t.view("syncs").select("task_id", "id", "status"), t.view("logs").select("task_id")).select("id"), "SELECT id FROM syncs WHERE status = 'failed' AND task_id IN (SELECT task_id FROM logs)")


def of_user(t):
    """Events as versions of users."""
    data = F.map_from_arrays(F.array(F.lit("type"), F.lit("value")), F.array("event_type", F.col("value").cast("string")))
    return t.events.select(F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.col("event_id").alias("seq"), data.alias("data"), F.col("ts").cast("timestamp").alias("created_at"))


register("version_change_type", lambda t: versions.with_changes(of_user(t)).select("entity_id", "seq", "change_type", F.array_contains("changed_fields", "type").alias("type_changed")), """
SELECT CAST(user_id AS VARCHAR) AS entity_id, event_id AS seq, CASE WHEN lag(event_type) OVER w IS NULL THEN 'create' ELSE 'update' END AS change_type, coalesce(lag(event_type) OVER w <> event_type, true) AS type_changed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
register("version_history_keep_n", lambda t: versions.history(of_user(t), 20).select("entity_id", "seq", "place"), """
SELECT entity_id, seq, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS INT) AS place FROM (SELECT CAST(user_id AS VARCHAR) AS entity_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20)""")
register("version_latest", lambda t: versions.latest(of_user(t)).select("entity_id", "seq"), "SELECT CAST(user_id AS VARCHAR) AS entity_id, MAX(event_id) AS seq FROM events GROUP BY 1")
register("version_prune", lambda t: versions.prune(of_user(t), AS_OF_LOGS, 10, 5).select("entity_id", "seq"), """
SELECT CAST(user_id AS VARCHAR) AS entity_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10 OR ts >= TIMESTAMP '2024-01-26 00:00:00'""")
register("version_statistics", lambda t: versions.version_statistics(versions.with_changes(of_user(t))), """
SELECT 'user' AS entity_type, change_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS entities FROM (SELECT user_id, CASE WHEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 'create' ELSE 'update' END AS change_type FROM events) GROUP BY 2""")


def as_map(df):
    given = lambda c: F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))
    return df.select("id", F.map_from_entries(F.filter(F.array(given("title"), given("description")), lambda e: e["value"].isNotNull())).alias("data"))


register("version_diff", lambda t: versions.diff(as_map(t.view("products")), as_map(t.view("products").where("id % 5 <> 1").withColumn("title", F.when(F.col("id") % 2 == 0, F.upper("title")).otherwise(F.col("title"))))), """
WITH old AS (SELECT id, 'title' AS field, title AS v FROM products UNION ALL SELECT id, 'description', description FROM products WHERE description IS NOT NULL),
new AS (SELECT id, field, CASE WHEN field = 'title' AND id % 2 = 0 THEN upper(v) ELSE v END AS v FROM old WHERE id % 5 <> 1)
SELECT id, field, old.v AS old_value, new.v AS new_value, CASE WHEN old.v IS NULL THEN 'added' WHEN new.v IS NULL THEN 'removed' ELSE 'modified' END AS change_type FROM old FULL JOIN new USING (id, field) WHERE old.v IS DISTINCT FROM new.v""")
register("version_append_changed", lambda t: versions.append_changed(of_user(t), versions.latest(of_user(t)).where("CAST(entity_id AS INT) % 2 = 0").select("entity_type", "entity_id", F.map_from_arrays(F.array(F.lit("type")), F.array(F.lit("changed"))).alias("data"), "created_at")).select("entity_id", "seq"), "SELECT CAST(user_id AS VARCHAR) AS entity_id, MAX(event_id) + 1 AS seq FROM events WHERE user_id % 2 = 0 GROUP BY user_id")
register("version_revert", lambda t: versions.revert(versions.with_changes(of_user(t)), of_user(t).groupBy("entity_type", "entity_id").agg(F.min("seq").alias("seq"))).select("entity_id", "seq", "change_type"), "SELECT CAST(user_id AS VARCHAR) AS entity_id, MAX(event_id) + 1 AS seq, 'update' AS change_type FROM events GROUP BY user_id")

register("exact_groups", lambda t: dedup.exact_groups(t.view("products"), "title", "brand", "description"), "SELECT concat_ws('|', title, brand, coalesce(description, '')) AS block, COUNT(*) AS n FROM products GROUP BY 1 HAVING COUNT(*) > 1")
register("master_records", lambda t: dedup.masters(t.view("products"), ["title", "brand"], score=dedup.completeness_score(t.view("products"), [(30, ("title", "description", "main_image_url")), (20, ("price_min", "price_max"))])).select("id", F.round("score", 6).alias("score")), """
SELECT id, round(score, 6) AS score FROM (SELECT id, title, brand, (1 + CASE WHEN description <> '' THEN 1 ELSE 0 END + CASE WHEN main_image_url <> '' THEN 1 ELSE 0 END) / CAST(3 AS DOUBLE) * 30 + 20 AS score FROM products) QUALIFY row_number() OVER (PARTITION BY title, brand ORDER BY score DESC, id) = 1""")
register("consistency_pairs_or_join", lambda t: dedup.equal_name_or_phone(t.view("suppliers")), "SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM (SELECT id, name, phone FROM suppliers) a JOIN (SELECT id, name, phone FROM suppliers) b ON a.id < b.id AND (a.name = b.name OR a.phone = b.phone)")
register("same_fields_of_groups", lambda t: dedup.same_fields(t.view("products"), ["title"], ["brand", "currency"]).select("title", F.array_contains("same_fields", "currency").alias("one_currency")), "SELECT title, COUNT(DISTINCT currency) = 1 AS one_currency FROM products GROUP BY 1")
near = lambda: F.concat_ws("|", "brand", "category_name", F.floor(F.col("price_min") / 5).cast("string"))
register("pairwise_similarity", lambda t: dedup.similar_pairs(t.view("products"), near(), dedup.PRODUCT_WEIGHTS, 0.5))
register("greedy_duplicate_groups", lambda t: dedup.greedy_groups(t.view("products"), near(), dedup.PRODUCT_WEIGHTS, 0.5))
register("first_seen_filter", lambda t: dedup.first_seen(t.view("logs"), ["timestamp", "id"], "error_type").select("id", "error_type"), "SELECT id, error_type FROM logs QUALIFY error_type IS NULL OR row_number() OVER (PARTITION BY error_type ORDER BY timestamp, id) = 1")
register("first_seen_two_keys", lambda t: dedup.first_seen(t.view("logs"), ["timestamp", "id"], "user_id", "event_type").select("id", "user_id", "event_type"), """
SELECT id, user_id, event_type FROM (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp, id) = 1) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY timestamp, id) = 1""")

COMPLETE = """0.5 * (1 + 1) / 2 + 0.3 * (COUNT(*) FILTER (trim(description) <> '') * 1.0 / COUNT(*) + COUNT(price_min) * 1.0 / COUNT(*) + COUNT(*) FILTER (main_image_url <> '') * 1.0 / COUNT(*)) / 3"""
register("quality_completeness", lambda t: quality.completeness(t.view("products"), quality.PRODUCT_FIELDS).select(F.round("value", 9).alias("value")), f"SELECT round(CAST({COMPLETE} AS DOUBLE), 9) AS value FROM products")
register("quality_accuracy", lambda t: quality.accuracy(t.view("products").withColumn("sales_count", F.col("sales_count") * 30_000)), "SELECT COUNT(*) FILTER (price_min BETWEEN 0.01 AND 1000000 AND price_max BETWEEN 0.01 AND 1000000 AND price_min <= price_max AND rating BETWEEN 0 AND 5 AND sales_count * 30000 <= 10000000) / CAST(COUNT(*) AS DOUBLE) AS value FROM products")
register("quality_validity", lambda t: quality.validity(t.view("suppliers"), emails=("email",), phones=("phone",)), "SELECT COUNT(*) FILTER (email LIKE '%@%') / CAST(COUNT(*) AS DOUBLE) AS value FROM suppliers")
register("quality_uniqueness", lambda t: quality.uniqueness(t.view("products"), ("source_id", "title")), "SELECT ((2 * COUNT(DISTINCT source_id) - COUNT(source_id)) / CAST(COUNT(*) AS DOUBLE) + (2 * COUNT(DISTINCT title) - COUNT(title)) / CAST(COUNT(*) AS DOUBLE)) / 2 AS value FROM products")
register("quality_consistency", lambda t: quality.consistency(t.view("products"), ("title",), "currency", quality.equal_text_pairs(t.view("products"), "title")).select(F.round("value", 6).alias("value")), """
WITH p AS (SELECT SUM(c * (c - 1) / 2) AS pairs FROM (SELECT COUNT(*) AS c FROM products GROUP BY title))
SELECT round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), v - 0.3 * pairs / n)), 6) AS value FROM (SELECT COUNT(*) AS n, CAST(0.3 AS DOUBLE) * (1 - COUNT(DISTINCT currency) / CAST(COUNT(*) AS DOUBLE)) + 0.2 * (1 - least(stddev_samp(length(title)) / avg(length(title)), 1)) AS v FROM products), p""")
register("equal_text_pairs", lambda t: quality.equal_text_pairs(t.view("products"), "title"), "SELECT CAST(SUM(c * (c - 1) // 2) AS BIGINT) AS n FROM (SELECT COUNT(*) AS c FROM products GROUP BY title)")


def report(t):
    p = t.view("products")
    return quality.quality_report({"completeness": quality.completeness(p, quality.PRODUCT_FIELDS), "accuracy": quality.accuracy(p), "validity": quality.validity(p, urls=("main_image_url",)), "uniqueness": quality.uniqueness(p, ("source_id", "title")), "consistency": quality.consistency(p, ("title",), "currency", quality.equal_text_pairs(p, "title"))})


register("quality_overall", report)
register("quality_recommendations", lambda t: quality.recommendations(report(t)))
