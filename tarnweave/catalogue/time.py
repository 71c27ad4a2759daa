"""Logs, metrics, progress, anomalies, alerts and streams."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import monitoring as mon
from ..operators import series
from ..streaming import events as stream
from .registry import registry
from .relational import avg
from .views import AS_OF_LOGS

QUERIES, ORACLE_SQL, register = registry()

METRICS = f"COUNT(value) AS n, MIN(value) AS min_value, MAX(value) AS max_value, {avg('value', 6)} AS avg_value"
register("metric_summary", lambda t: mon.metric_summary(t.view("logs"), "event_type"), f"SELECT event_type, {METRICS}, arg_max(value, (timestamp, id)) AS latest FROM logs GROUP BY 1")
register("metric_percentiles", lambda t: mon.percentiles(t.view("logs"), "event_type").select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "p95", "p99")]), "SELECT event_type, COUNT(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM logs GROUP BY 1")
register("metric_nearest_rank", lambda t: mon.nearest_rank(t.view("logs"), "event_type", {"p50": 0.5, "p95": 0.95}), "SELECT event_type, COUNT(*) AS n, list_sort(list(value))[CAST(floor(COUNT(*) * CAST(0.5 AS DOUBLE)) AS INT) + 1] AS p50, list_sort(list(value))[CAST(floor(COUNT(*) * CAST(0.95 AS DOUBLE)) AS INT) + 1] AS p95 FROM logs GROUP BY 1")
requests = lambda t: t.view("logs").select("id", "timestamp", "user_id", F.col("event_type").alias("endpoint"), F.col("value").alias("response_time"), F.when(F.col("id") % 50 == 0, 500).when(F.col("id") % 20 == 0, 404).otherwise(200).alias("status_code"))
register("request_stats_by_endpoint", lambda t: mon.request_statistics(requests(t), "endpoint").withColumns({c: F.round(c, 6) for c in ("p95_time", "p99_time")}), f"""
SELECT event_type AS endpoint, COUNT(*) AS n, {avg('value', 6)} AS avg_time, round(quantile_cont(value, 0.95), 6) AS p95_time, round(quantile_cont(value, 0.99), 6) AS p99_time, COUNT(*) FILTER (id % 50 <> 0 AND id % 20 <> 0) AS succeeded, MAX(value) AS max_time, COUNT(*) FILTER (id % 50 <> 0 AND id % 20 <> 0) * CAST(100 AS DOUBLE) / COUNT(*) AS success_percent FROM logs GROUP BY 1""")
register("request_alerts", lambda t: mon.request_alerts(requests(t), 100.0).select("id", "reason"), "SELECT id, CASE WHEN id % 50 = 0 THEN 'server_error' ELSE 'slow' END AS reason FROM logs WHERE id % 50 = 0 OR value > 100")
PATTERN = r"lower(regexp_replace(message, '\d+', '{N}', 'g'))"
register("log_patterns", lambda t: mon.log_patterns(t.view("logs")).select("pattern", "n", "errors"), f"SELECT {PATTERN} AS pattern, COUNT(*) AS n, COUNT(*) FILTER (level = 'ERROR') AS errors FROM logs GROUP BY 1 HAVING COUNT(*) >= 5 ORDER BY n DESC, 1 LIMIT 1000")
register("log_pattern_samples", lambda t: mon.pattern_samples(t.view("logs"), mon.log_patterns(t.view("logs"))).select("pattern", "id", "place"), f"SELECT {PATTERN} AS pattern, id, CAST(row_number() OVER (PARTITION BY {PATTERN} ORDER BY timestamp DESC, id DESC) AS INT) AS place FROM logs QUALIFY place <= 5")
register("log_pattern_context", lambda t: mon.pattern_context(t.view("logs"), "task_id"), f"SELECT pattern, task_id, n, CAST(row_number() OVER (PARTITION BY pattern ORDER BY n DESC, task_id) AS INT) AS place FROM (SELECT {PATTERN} AS pattern, task_id, COUNT(*) AS n FROM logs GROUP BY 1, 2) QUALIFY place <= 5")
register("error_groups", lambda t: mon.error_groups(t.view("logs").where("level = 'ERROR'").select("error_type", F.lit("failed").alias("message"), "timestamp", "user_id")).select("fingerprint", "occurrences", "users"), "SELECT substr(md5(error_type || '|failed|'), 1, 16) AS fingerprint, COUNT(*) AS occurrences, COUNT(DISTINCT user_id) AS users FROM logs WHERE level = 'ERROR' GROUP BY 1")
register("unpivot_metrics", lambda t: mon.unpivot_metrics(t.lineitem, ["l_orderkey", "l_linenumber"], {c: F.col(c) for c in ("l_quantity", "l_discount", "l_tax")}), """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")

register("error_rate_anomaly", lambda t: series.error_rate_anomaly(t.view("logs")), "SELECT COUNT(*) AS total, COUNT(*) FILTER (level = 'ERROR') AS errors, COUNT(*) FILTER (level = 'ERROR') / CAST(COUNT(*) AS DOUBLE) AS rate, COUNT(*) FILTER (level = 'ERROR') / CAST(COUNT(*) AS DOUBLE) > 0.1 AS anomaly, CASE WHEN COUNT(*) FILTER (level = 'ERROR') / CAST(COUNT(*) AS DOUBLE) > 0.25 THEN 'high' ELSE 'medium' END AS severity, least(COUNT(*) FILTER (level = 'ERROR') / CAST(COUNT(*) AS DOUBLE) / CAST(0.05 AS DOUBLE), 1) AS confidence FROM logs")
register("frequency_anomaly", lambda t: series.frequency_anomalies(t.view("logs"), unit="hour").select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n", F.round("z", 6).alias("z")), """
SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, n, round(abs(n - m) / s, 6) AS z FROM (SELECT date_trunc('hour', timestamp) AS bucket, COUNT(*) AS n FROM logs GROUP BY 1), (SELECT avg(n) AS m, stddev_samp(n) AS s FROM (SELECT COUNT(*) AS n FROM logs GROUP BY date_trunc('hour', timestamp))) WHERE abs(n - m) / s > 2""")
register("performance_zscore", lambda t: series.recent_against_history(t.view("logs"), "user_id", "timestamp", "value", "id").select("user_id", "history", F.round("z", 6).alias("z"), "anomaly"), """
SELECT user_id, COUNT(*) FILTER (r > 30) AS history, round(abs(avg(value) FILTER (r <= 30) - avg(value) FILTER (r > 30)) / stddev_samp(value) FILTER (r > 30), 6) AS z, abs(avg(value) FILTER (r <= 30) - avg(value) FILTER (r > 30)) / stddev_samp(value) FILTER (r > 30) > 2 AS anomaly
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS r FROM logs) GROUP BY 1 HAVING COUNT(*) FILTER (r > 30) >= 10""")
register("trend_regression", lambda t: series.trend(t.view("logs"), "user_id", "timestamp", "value", "id").select("user_id", "n", F.round("slope", 6).alias("slope")), "SELECT user_id, COUNT(*) AS n, round(regr_slope(value, -r), 6) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS r FROM logs) WHERE r <= 100 GROUP BY 1")
register("error_trend_24h", lambda t: series.error_trend(t.view("logs"), AS_OF_LOGS), """
SELECT *, CASE WHEN recent > 1.2 * previous THEN 'increasing' WHEN recent < 0.8 * previous THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT COUNT(*) FILTER (level = 'ERROR' AND timestamp > TIMESTAMP '2024-01-30 00:00:00') AS recent, COUNT(*) FILTER (level = 'ERROR' AND timestamp > TIMESTAMP '2024-01-29 00:00:00' AND timestamp <= TIMESTAMP '2024-01-30 00:00:00') AS previous FROM logs)""")
RULES = [("r1", "slow clicks", "click", "avg", "gt", 40.0, 86400 * 7, "warning"), ("r2", "many errors", "error", "count", "gte", 10.0, 86400, "critical"), ("r3", "top view", "view", "max", "lt", 100.0, 86400, "info"), ("r4", "none", "missing", "count", "eq", 0.0, 3600, "info")]


def alert_rules(t):
    points = t.view("logs").select(F.col("event_type").alias("metric"), "value", "timestamp", "id")
    return mon.evaluate_rules(points, t.spark.createDataFrame(RULES, mon.RULES), AS_OF_LOGS)


register("alert_rules_eval", alert_rules, """
WITH found AS (SELECT 'r1' AS rule_id, 'slow clicks' AS name, 'warning' AS level, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / COUNT(*) AS value FROM logs WHERE event_type = 'click' AND timestamp >= TIMESTAMP '2024-01-24'
UNION ALL SELECT 'r2', 'many errors', 'critical', COUNT(*), CAST(COUNT(*) AS DOUBLE) FROM logs WHERE event_type = 'error' AND timestamp >= TIMESTAMP '2024-01-30' UNION ALL SELECT 'r3', 'top view', 'info', COUNT(*), MAX(value) FROM logs WHERE event_type = 'view' AND timestamp >= TIMESTAMP '2024-01-30'
UNION ALL SELECT 'r4', 'none', 'info', CAST(0 AS BIGINT), CAST(0 AS DOUBLE))
SELECT *, coalesce(CASE rule_id WHEN 'r1' THEN value > 40 WHEN 'r2' THEN value >= 10 WHEN 'r3' THEN value < 100 ELSE true END, false) AS firing FROM found""")
register("system_health", lambda t: mon.system_health(t.view("logs").select(F.when(F.col("event_type") == "click", "cpu").when(F.col("event_type") == "view", "memory").otherwise("disk").alias("metric"), (F.col("value") * 2).alias("value"), "timestamp"), AS_OF_LOGS, 86400 * 40).select("status"), """
SELECT CASE WHEN d > 95 THEN 'critical' WHEN d > 85 THEN 'warning' WHEN m > 90 THEN 'critical' WHEN m > 80 THEN 'warning' WHEN c > 90 THEN 'critical' WHEN c > 80 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT avg(value * 2) FILTER (event_type = 'click') AS c, avg(value * 2) FILTER (event_type = 'view') AS m, avg(value * 2) FILTER (event_type NOT IN ('click', 'view')) AS d FROM logs)""")
register("queue_status", lambda t: mon.queue_status(t.view("syncs").select(F.col("operation_type").alias("queue_name"), "status", F.col("duration").alias("wait_s"))), f"""
SELECT operation_type AS queue_name, CAST(0 AS BIGINT) AS pending, COUNT(*) FILTER (status = 'running') AS active, COUNT(*) FILTER (status = 'failed') AS failed, COUNT(*) AS total, {avg('duration')} AS avg_wait, MAX(duration) AS max_wait, COUNT(*) FILTER (status = 'failed') * CAST(100 AS DOUBLE) / COUNT(*) AS failed_percent FROM syncs GROUP BY 1""")
register("operation_summary", lambda t: mon.operation_summary(t.view("logs").select(F.col("task_id").alias("operation"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "started").otherwise("completed").alias("phase"), "duration")), f"""
SELECT task_id AS operation, COUNT(*) FILTER (event_type = 'click') AS started, COUNT(*) FILTER (event_type NOT IN ('click', 'error')) AS completed, COUNT(*) FILTER (event_type = 'error') AS failed, {avg('duration', 6)} AS avg_duration FROM logs GROUP BY 1""")

points = lambda t: t.view("logs").select("id", "user_id", "timestamp", F.col("id").cast("double").alias("current"), F.lit(1e6).alias("total"))
SECONDS = "CAST(epoch_us({0}) AS DOUBLE) / CAST(1000000 AS DOUBLE)"
register("progress_speed", lambda t: series.progress_speed(points(t), "user_id").select("user_id", "steps", F.round("avg_speed", 6).alias("avg_speed"), "trend"), f"""
SELECT user_id, COUNT(*) AS steps, round(avg(s), 6) AS avg_speed, CASE WHEN arg_max(s, o) > arg_min(s, o) THEN 'increasing' WHEN arg_max(s, o) < arg_min(s, o) THEN 'decreasing' ELSE 'stable' END AS trend
FROM (SELECT user_id, (timestamp, id) AS o, (id - lag(id) OVER w) / ({SECONDS.format('timestamp')} - lag({SECONDS.format('timestamp')}) OVER w) AS s FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id)) WHERE s IS NOT NULL GROUP BY 1""")
register("progress_eta", lambda t: series.progress_eta(points(t), "user_id").select("id", F.round("avg_speed", 6).alias("avg_speed"), F.round("instant_speed", 6).alias("instant_speed")), f"""
SELECT id, round(coalesce((id - first(id) OVER v) / nullif({SECONDS.format('timestamp')} - first({SECONDS.format('timestamp')}) OVER v, 0), 0), 6) AS avg_speed, round(coalesce((id - lag(id, 2) OVER w) / nullif({SECONDS.format('timestamp')} - lag({SECONDS.format('timestamp')}, 2) OVER w, 0), 0), 6) AS instant_speed
FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id), v AS (PARTITION BY user_id ORDER BY timestamp, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
register("running_total", lambda t: series.running_total(t.view("logs").select("id", "user_id", "timestamp", F.lit(1).alias("one")), "user_id", "timestamp", "one", "id").select("id", "total"), "SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, id) AS total FROM logs")
register("counter_rate", lambda t: series.counter_rate(points(t), "user_id", "timestamp", "current", "id").select("id", F.round("rate", 6).alias("rate")), f"SELECT id, round((id - lag(id) OVER w) / ({SECONDS.format('timestamp')} - lag({SECONDS.format('timestamp')}) OVER w), 6) AS rate FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id)")
register("sustained_condition", lambda t: series.sustained(t.view("logs"), "user_id", "timestamp", F.col("value") > 20, 7200).select("id", "firing"), "SELECT id, bool_and(value > 20) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(timestamp)) AS BIGINT) RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS firing FROM logs")
register("rate_limit_accepted", lambda t: series.accepted_requests(t.view("logs"), "user_id", "timestamp", "id", limit=2, window_s=86400.0), """
WITH RECURSIVE a AS (SELECT id, user_id, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, id) AS n FROM logs),
r AS (SELECT id, user_id, n, true AS accepted, CAST(NULL AS BIGINT) AS older, t AS newer FROM a WHERE n = 1
  UNION ALL SELECT a.id, a.user_id, a.n, r.older IS NULL OR r.older <= a.t - 86400000000, CASE WHEN r.older IS NULL OR r.older <= a.t - 86400000000 THEN r.newer ELSE r.older END,
    CASE WHEN r.older IS NULL OR r.older <= a.t - 86400000000 THEN a.t ELSE r.newer END FROM r JOIN a ON a.n = r.n + 1 AND a.user_id = r.user_id)
SELECT id, user_id, accepted FROM r""")
register("alert_cooldown", lambda t: series.sent_alerts(t.view("logs").where("level = 'ERROR'"), "error_type", "timestamp", "id", cooldown_s=7200.0), """
WITH RECURSIVE a AS (SELECT id, error_type, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY error_type ORDER BY timestamp, id) AS n FROM logs WHERE level = 'ERROR'),
r AS (SELECT id, error_type, n, true AS sent, t AS last FROM a WHERE n = 1
  UNION ALL SELECT a.id, a.error_type, a.n, a.t - r.last >= 7200000000, CASE WHEN a.t - r.last >= 7200000000 THEN a.t ELSE r.last END FROM r JOIN a ON a.n = r.n + 1 AND a.error_type IS NOT DISTINCT FROM r.error_type)
SELECT id, error_type, sent FROM r""")


def stream_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, or where none is set (local runs) in the temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = folder or os.path.join(tempfile.gettempdir(), "tarnweave-shared")
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def streamed(t, build, mode="append", keys=None):
    return stream.run_to_end(build(stream.event_stream(t.spark, t.folder)), mode, stream_folder(t.spark), keys)


START = lambda df: df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
register("stream_tumbling_counts", lambda t: START(streamed(t, stream.tumbling_counts, "update", ["start", "event_type"])), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
register("stream_sliding_means", lambda t: START(streamed(t, stream.sliding_means, "update", ["start", "event_type"])), f"""
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS n, {avg('value', 6)} AS avg_value FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s, event_type, value FROM events) GROUP BY 1, 2""")
register("stream_sessions", lambda t: START(streamed(t, stream.sessions, "complete")), """
SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS start, COUNT(*) AS n FROM (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")
register("stream_first_seen", lambda t: streamed(t, lambda s: stream.first_seen(s, "event_id").select("event_id", "user_id")), "SELECT event_id, user_id FROM events")
register("stream_error_state", lambda t: streamed(t, stream.error_state, "update", ["user_id"]).select("user_id", "n"), "SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
