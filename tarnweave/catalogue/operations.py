"""Operating figures, alerts, errors, checkpoints, recovery and resumption."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as mon
from ..operators import operations as ops
from ..operators import recovery as rec
from ..operators import rows
from .registry import registry
from .relational import avg
from .views import AS_OF_LOGS

QUERIES, ORACLE_SQL, register = registry()

DOUBLE = "CAST({0} AS DOUBLE)"
DAY, WEEK = 86_400, 604_800
text_time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
SHOWN_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def requests(t):
    status = F.when(F.col("id") % 50 == 0, 500).when(F.col("id") % 20 == 0, 404).otherwise(200)
    return t.view("logs").select(
        "id", "timestamp", F.col("event_type").alias("endpoint"), F.lit("GET").alias("method"), F.col("value").alias("response_time"), status.alias("status_code"),
        (F.col("id") % 1000).alias("request_size"), (F.col("id") % 7).alias("response_size"),
    )


REQUESTS = """requests AS (SELECT id, timestamp, event_type AS endpoint, value AS response_time, CASE WHEN id % 50 = 0 THEN 500 WHEN id % 20 = 0 THEN 404 ELSE 200 END AS status_code FROM logs)"""
register(
    "request_report",
    lambda t: mon.request_report(requests(t), AS_OF_LOGS, 10_080, "endpoint").withColumns({c: F.round(c, 6) for c in ("p95_time", "p99_time", "requests_per_minute")}),
    f"""WITH {REQUESTS},
recent AS (SELECT * FROM requests WHERE timestamp >= TIMESTAMP '{AS_OF_LOGS}' - INTERVAL 10080 MINUTE),
codes AS (SELECT endpoint, string_agg(code, ',' ORDER BY code) AS status_codes FROM (SELECT endpoint, status_code || '=' || COUNT(*) AS code FROM recent GROUP BY endpoint, status_code) GROUP BY 1)
SELECT endpoint, COUNT(*) AS n, {avg('response_time', 6)} AS avg_time, COUNT(*) FILTER (status_code BETWEEN 200 AND 399) AS succeeded, MAX(response_time) AS max_time,
  COUNT(*) FILTER (status_code BETWEEN 200 AND 399) * CAST(100 AS DOUBLE) / COUNT(*) AS success_percent, round(quantile_cont(response_time, 0.95), 6) AS p95_time, round(quantile_cont(response_time, 0.99), 6) AS p99_time,
  round(COUNT(*) / CAST(10080 AS DOUBLE), 6) AS requests_per_minute, any_value(status_codes) AS status_codes
FROM recent JOIN codes USING (endpoint) GROUP BY 1""",
)
register(
    "request_metrics",
    lambda t: ops.request_metrics(requests(t)).select("id", "metric", "kind", "value", F.try_element_at("tags", F.lit("status")).alias("status"), F.try_element_at("tags", F.lit("endpoint")).alias("endpoint")),
    f"""WITH {REQUESTS}
SELECT id, 'request_count' AS metric, 'counter' AS kind, CAST(1 AS DOUBLE) AS value, CAST(status_code AS VARCHAR) AS status, endpoint FROM requests
UNION ALL SELECT id, 'request_response_time', 'histogram', response_time, NULL, endpoint FROM requests
UNION ALL SELECT id, 'request_size', 'histogram', CAST(id % 1000 AS DOUBLE), NULL, endpoint FROM requests
UNION ALL SELECT id, 'response_size', 'histogram', CAST(id % 7 AS DOUBLE), NULL, endpoint FROM requests""",
)


def metric_points(t):
    is_ = lambda kind: F.col("event_type") == kind
    kind = F.when(is_("click") | is_("error"), "counter").when(is_("view"), "timer").otherwise("gauge")
    name = F.when(is_("click"), "total_requests").when(is_("error"), "error_count").when(is_("view"), "request_duration").otherwise("active_tasks")
    return t.view("logs").select("id", "timestamp", "value", kind.alias("kind"), name.alias("name"))


SUM6 = "coalesce(CAST(SUM(CAST(value AS DECIMAL(18,6))) FILTER (event_type = '{0}') AS DOUBLE), 0)"
register(
    "application_metrics",
    lambda t: ops.application_metrics(metric_points(t), 3600.0).select("total_requests", "error_count", "active_tasks", *[F.round(c, 6).alias(c) for c in ("avg_response_time", "request_rate", "error_rate")]),
    f"""SELECT {SUM6.format('click')} AS total_requests, {SUM6.format('error')} AS error_count,
  coalesce(arg_max(value, (timestamp, id)) FILTER (event_type NOT IN ('click', 'error', 'view')), 0) AS active_tasks,
  round(coalesce({SUM6.format('view')} / COUNT(value) FILTER (event_type = 'view'), 0), 6) AS avg_response_time,
  round({SUM6.format('click')} / CAST(3600 AS DOUBLE), 6) AS request_rate, round({SUM6.format('error')} / {SUM6.format('click')}, 6) AS error_rate FROM logs""",
)
register(
    "query_statistics",
    lambda t: ops.query_statistics(t.view("syncs").select("operation_type", (F.col("duration") / F.lit(100.0)).alias("execution_time"), (F.col("status") == "completed").alias("success")), "operation_type"),
    """SELECT operation_type, COUNT(*) AS total, COUNT(*) FILTER (success) AS successful, COUNT(*) FILTER (NOT success) AS failed,
  coalesce(CAST(SUM(CAST(x AS DECIMAL(18,6))) FILTER (success) AS DOUBLE) / COUNT(x) FILTER (success), 0) AS avg_time, coalesce(MAX(x) FILTER (success), 0) AS max_time,
  COUNT(*) FILTER (x > 1) AS slow, CAST(COUNT(*) FILTER (success) AS DOUBLE) / COUNT(*) AS success_rate
FROM (SELECT operation_type, duration / CAST(100 AS DOUBLE) AS x, status = 'completed' AS success FROM syncs) GROUP BY 1""",
)
register(
    "memory_trend",
    lambda t: ops.memory_trend(t.view("logs").withColumnRenamed("value", "memory_mb"), AS_OF_LOGS, "task_id", minutes=1440).withColumns({c: F.round(c, 6) for c in ("change_mb", "change_mb_per_min")}),
    f"""WITH p AS (SELECT task_id, COUNT(*) AS points, arg_min(value, (timestamp, id)) AS start_mb, arg_max(value, (timestamp, id)) AS end_mb
  FROM logs WHERE timestamp BETWEEN TIMESTAMP '{AS_OF_LOGS}' - INTERVAL 1 DAY AND TIMESTAMP '{AS_OF_LOGS}' GROUP BY 1)
SELECT task_id, points, start_mb, end_mb, round(end_mb - start_mb, 6) AS change_mb, round((end_mb - start_mb) / CAST(1440 AS DOUBLE), 6) AS change_mb_per_min,
  CASE WHEN points < 2 THEN 'insufficient_data' WHEN (end_mb - start_mb) / 1440 > 1 THEN 'increasing' WHEN (end_mb - start_mb) / 1440 < -1 THEN 'decreasing' ELSE 'stable' END AS trend FROM p""",
)
register(
    "snapshot_difference",
    lambda t: ops.snapshot_difference(t.view("logs").select("id", "user_id", "timestamp", "value"), "user_id", "value").select("id", F.round("value_change", 6).alias("value_change")),
    "SELECT id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY timestamp, id), 6) AS value_change FROM logs",
)


def worker_rows(t):
    workers = t.view("logs").groupBy(F.col("task_id").alias("worker_name")).agg(F.count("*").alias("total_tasks")).withColumn("answers", F.col("total_tasks") % 3 != 0)
    return ops.worker_status(workers, t.view("syncs").withColumnRenamed("task_id", "worker_name"))


WORKERS = f"""workers AS (SELECT task_id AS worker_name, total_tasks, coalesce(active_tasks, 0) AS active_tasks,
  CASE WHEN total_tasks % 3 = 0 THEN 'stopped' WHEN active_tasks > {ops.DEGRADED_TASKS} THEN 'degraded' ELSE 'running' END AS status
  FROM (SELECT task_id, COUNT(*) AS total_tasks FROM logs GROUP BY 1) LEFT JOIN (SELECT task_id, COUNT(*) AS active_tasks FROM syncs WHERE status = 'running' GROUP BY 1) USING (task_id))"""
register("worker_status", worker_rows, f"WITH {WORKERS} SELECT * FROM workers")
register(
    "queue_health",
    lambda t: ops.queue_health(mon.queue_status(t.view("syncs").select(F.col("operation_type").alias("queue_name"), "status", F.col("duration").alias("wait_s"))), worker_rows(t))
    .select("pending", "failed", "active", "stopped_workers", F.round("avg_wait", 3).alias("avg_wait"), F.round("error_rate", 6).alias("error_rate"), "status", F.array_join("alerts", ",").alias("alerts")),
    f"""WITH {WORKERS},
q AS (SELECT operation_type, COUNT(*) FILTER (status = 'failed') AS failed, {avg('duration')} AS w FROM syncs GROUP BY 1),
o AS (SELECT CAST(0 AS BIGINT) AS pending, CAST(SUM(failed) AS BIGINT) AS failed, avg(w) AS avg_wait FROM q),
a AS (SELECT CAST(SUM(active_tasks) AS BIGINT) AS active, COUNT(*) FILTER (status = 'stopped') AS stopped_workers FROM workers),
s AS (SELECT *, CAST(failed AS DOUBLE) / (active + failed) AS e FROM o, a)
SELECT pending, failed, active, stopped_workers, round(avg_wait, 3) AS avg_wait, round(e, 6) AS error_rate,
  CASE WHEN e > 0.15 OR avg_wait > 180 THEN 'critical' WHEN e > 0.05 OR avg_wait > 60 OR stopped_workers > 0 THEN 'warning' ELSE 'healthy' END AS status,
  array_to_string(list_filter([CASE WHEN e > 0.15 THEN 'error_rate_critical' WHEN e > 0.05 THEN 'error_rate_warning' END, CASE WHEN avg_wait > 180 THEN 'avg_wait_critical' WHEN avg_wait > 60 THEN 'avg_wait_warning' END,
    CASE WHEN stopped_workers > 0 THEN 'workers_stopped' END], lambda x : x IS NOT NULL), ',') AS alerts FROM s""",
)
register(
    "instant_rate",
    lambda t: ops.instant_rate(t.view("logs").select("id", "user_id", "timestamp", F.col("id").alias("value")), "user_id", AS_OF_LOGS, WEEK).select("user_id", F.round("rate", 6).alias("rate")),
    f"""WITH r AS (SELECT user_id, id, epoch_us(timestamp) / CAST(1000000 AS DOUBLE) AS s, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS n
  FROM logs WHERE epoch(date_trunc('second', timestamp)) BETWEEN epoch(TIMESTAMP '{AS_OF_LOGS}') - {WEEK} AND epoch(TIMESTAMP '{AS_OF_LOGS}'))
SELECT a.user_id, round(CASE WHEN a.id >= b.id THEN a.id - b.id ELSE a.id END / nullif(a.s - b.s, 0), 6) AS rate FROM r a JOIN r b ON a.user_id = b.user_id AND a.n = 1 AND b.n = 2""",
)
BOUNDS = [1.0, 5.0, 25.0, 50.0, 100.0, 250.0]
BUCKETS = f"""b AS (SELECT event_type, le, COUNT(*) FILTER (value <= le) AS n FROM logs, (SELECT unnest({BOUNDS + [1e308]}) AS le) WHERE value IS NOT NULL GROUP BY 1, 2)"""
register(
    "histogram_buckets",
    lambda t: ops.histogram_buckets(t.view("logs"), BOUNDS, "event_type").withColumn("le", F.when(F.col("le") < 1e300, F.col("le"))),
    f"WITH {BUCKETS} SELECT event_type, CASE WHEN le < 1e300 THEN CAST(le AS DOUBLE) END AS le, n FROM b",
)
register(
    "histogram_quantile",
    lambda t: ops.histogram_quantile(ops.histogram_buckets(t.view("logs"), BOUNDS, "event_type"), 0.95, "event_type").withColumn("quantile", F.round("quantile", 6)),
    f"""WITH {BUCKETS},
w AS (SELECT *, coalesce(lag(le) OVER v, 0) AS low, coalesce(lag(n) OVER v, 0) AS below, MAX(n) OVER (PARTITION BY event_type) * CAST(0.95 AS DOUBLE) AS r FROM b WINDOW v AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(CASE WHEN le > 1e300 THEN low ELSE low + (le - low) * (r - below) / (n - below) END, 6) AS quantile FROM w WHERE n >= r AND below < r""",
)


def happened(t):
    what = F.when(F.col("event_type") == "error", "fire").when(F.col("event_type") == "signup", "acknowledge").when(F.col("id") % 37 == 0, "resolve")
    return t.view("logs").select(F.col("task_id").alias("rule_id"), "timestamp", "id", what.alias("what"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("who")).where("what IS NOT NULL")


register(
    "alert_cycle",
    lambda t: ops.alert_cycle(happened(t)).select("rule_id", "episode", text_time("triggered_at"), "fires", "status", text_time("acknowledged_at"), "acknowledged_by", text_time("resolved_at"), "resolved_by"),
    f"""WITH h AS (SELECT task_id AS rule_id, timestamp, id, CASE WHEN event_type = 'error' THEN 'fire' WHEN event_type = 'signup' THEN 'acknowledge' WHEN id % 37 = 0 THEN 'resolve' END AS what, 'u' || user_id AS who FROM logs),
p AS (SELECT *, coalesce(SUM(CASE WHEN what = 'resolve' THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM h WHERE what IS NOT NULL),
o AS (SELECT rule_id, part, MIN((timestamp, id)) AS opened FROM p WHERE what = 'fire' GROUP BY 1, 2),
g AS (SELECT rule_id, part, MIN(timestamp) AS t, COUNT(*) FILTER (what = 'fire') AS fires, arg_max(timestamp, (timestamp, id)) FILTER (what = 'acknowledge') AS a, arg_max(who, (timestamp, id)) FILTER (what = 'acknowledge') AS aw,
  arg_max(timestamp, (timestamp, id)) FILTER (what = 'resolve') AS e, arg_max(who, (timestamp, id)) FILTER (what = 'resolve') AS ew FROM p JOIN o USING (rule_id, part) WHERE (timestamp, id) >= opened GROUP BY 1, 2)
SELECT rule_id, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY part) AS INT) AS episode, {SHOWN_TIME.format('t')} AS triggered_at, fires,
  CASE WHEN e IS NOT NULL THEN 'resolved' WHEN a IS NOT NULL THEN 'acknowledged' ELSE 'active' END AS status,
  {SHOWN_TIME.format('a')} AS acknowledged_at, aw AS acknowledged_by, {SHOWN_TIME.format('e')} AS resolved_at, ew AS resolved_by FROM g""",
)
RECENT = f"epoch(date_trunc('second', timestamp)) BETWEEN epoch(TIMESTAMP '{AS_OF_LOGS}') - {{0}} AND epoch(TIMESTAMP '{AS_OF_LOGS}')"
register(
    "log_rule",
    lambda t: ops.log_rule(t.view("logs"), AS_OF_LOGS, WEEK, 5, holds="user 1"),
    f"SELECT COUNT(*) AS n, COUNT(*) >= 5 AS firing FROM logs WHERE level = 'ERROR' AND contains(message, 'user 1') AND {RECENT.format(WEEK)}",
)


def errors(t):
    severity = F.when(F.col("user_id") % 3 == 0, "high").otherwise("medium")
    return t.view("logs").where("level = 'ERROR'").select("id", "timestamp", "error_type", severity.alias("severity"), F.lit("open").alias("status"), F.concat_ws(":", "error_type", (F.col("user_id") % 3).cast("string")).alias("fingerprint"))


ERRORS = """errors AS (SELECT id, timestamp, error_type, CASE WHEN user_id % 3 = 0 THEN 'high' ELSE 'medium' END AS severity, 'open' AS status, error_type || ':' || (user_id % 3) AS fingerprint FROM logs WHERE level = 'ERROR')"""
register(
    "error_rule",
    lambda t: ops.error_rule(errors(t), AS_OF_LOGS, WEEK, 5, severity="high"),
    f"WITH {ERRORS} SELECT COUNT(*) AS n, COUNT(*) >= 5 AS firing FROM errors WHERE severity = 'high' AND {RECENT.format(WEEK)}",
)
register(
    "error_statistics",
    lambda t: ops.error_statistics(errors(t), AS_OF_LOGS, 168).withColumns({c: F.round(c, 6) for c in ("per_hour", "share_percent")}),
    f"""WITH {ERRORS}, e AS (SELECT * FROM errors WHERE {RECENT.format(WEEK)}),
c AS (SELECT 'severity' AS field, severity AS value, COUNT(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'error_type', error_type, COUNT(*) FROM e GROUP BY 2 UNION ALL SELECT 'status', status, COUNT(*) FROM e GROUP BY 2
  UNION ALL SELECT 'all', NULL, COUNT(*) FROM e)
SELECT field, value, n, round(n / CAST(168 AS DOUBLE), 6) AS per_hour, round(n * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM e), 6) AS share_percent FROM c""",
)


def error_event_rows(t):
    closed = t.view("logs").where("event_type = 'signup'").select(F.concat_ws(":", F.concat(F.lit("E"), (F.col("user_id") % 7).cast("string")), (F.col("user_id") % 3).cast("string")).alias("fingerprint"), "timestamp", F.lit("resolved").alias("status"))
    return ops.error_events(errors(t), closed)


EVENTS = f"""{ERRORS},
closed AS (SELECT 'E' || (user_id % 7) || ':' || (user_id % 3) AS fingerprint, MAX(timestamp) AS closed_at FROM logs WHERE event_type = 'signup' GROUP BY 1),
events_ AS (SELECT fingerprint, COUNT(*) AS occurrences, MIN(timestamp) AS first_seen, MAX(timestamp) AS last_seen, arg_min(error_type, (timestamp, id)) AS error_type, arg_min(severity, (timestamp, id)) AS severity FROM errors GROUP BY 1),
found AS (SELECT events_.*, CASE WHEN closed_at IS NULL OR last_seen > closed_at THEN 'open' ELSE 'resolved' END AS status, coalesce(last_seen > closed_at, false) AS reopened FROM events_ LEFT JOIN closed USING (fingerprint))"""
register(
    "error_events",
    lambda t: error_event_rows(t).select("fingerprint", "occurrences", text_time("first_seen"), text_time("last_seen"), "error_type", "severity", "status", "reopened"),
    f"WITH {EVENTS} SELECT fingerprint, occurrences, {SHOWN_TIME.format('first_seen')} AS first_seen, {SHOWN_TIME.format('last_seen')} AS last_seen, error_type, severity, status, reopened FROM found",
)
register(
    "errors_having",
    lambda t: ops.errors_having(error_event_rows(t), status="open", severity="medium", at_least=2, most=5).select("fingerprint", "occurrences"),
    f"WITH {EVENTS} SELECT fingerprint, occurrences FROM found WHERE status = 'open' AND severity = 'medium' AND occurrences >= 2 ORDER BY last_seen DESC, fingerprint LIMIT 5",
)
register(
    "log_insights",
    lambda t: ops.log_insights(t.view("logs"), AS_OF_LOGS, 168).select("total", "errors", F.round("error_rate", 6).alias("error_rate"), F.array_join("insights", ",").alias("insights"), F.size("advice").alias("advice")),
    f"""WITH r AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (level IN ('ERROR', 'CRITICAL')) AS errors, coalesce(CAST(COUNT(*) FILTER (level IN ('ERROR', 'CRITICAL')) AS DOUBLE) / nullif(COUNT(*), 0), 0) AS x FROM logs WHERE {RECENT.format(WEEK)})
SELECT total, errors, round(x, 6) AS error_rate, CASE WHEN total = 0 THEN 'no_logs' ELSE concat_ws(',', CASE WHEN x > 0.1 THEN 'error_rate_high' WHEN x < 0.01 THEN 'error_rate_very_low' END, CASE WHEN total > 10000 THEN 'many_logs' END) END AS insights,
  CAST((x > 0.1) AS INT) + CAST((total > 10000) AS INT) AS advice FROM r""",
)

running = lambda t: t.view("syncs").withColumn("status", F.when(F.col("status") == "completed", "running").otherwise(F.col("status")))
RATE = "coalesce(round({0} * CAST(100 AS DOUBLE) / nullif(processed_count, 0), {1}), 0)"
register(
    "sync_progress",
    lambda t: rec.sync_progress(running(t)).select("id", "success_rate", "failure_rate", "remaining_s"),
    f"""SELECT id, {RATE.format('success_count', 2)} AS success_rate, {RATE.format('failed_count', 2)} AS failure_rate,
  CASE WHEN status = 'completed' AND processed_count > 0 AND duration > 0 THEN CAST(trunc((100 - processed_count) * (CAST(duration AS DOUBLE) / processed_count)) AS BIGINT) ELSE 0 END AS remaining_s FROM syncs""",
)
register(
    "shown_progress",
    lambda t: rec.shown_progress(t.view("syncs")),
    f"SELECT id, CAST(floor(coalesce(duration, 0) / CAST(60 AS DOUBLE)) AS BIGINT) AS minutes, {RATE.format('success_count', 0)} AS rate FROM syncs",
)


def checkpoints(t):
    return rec.with_checkpoint_ids(t.view("logs").select("task_id", F.concat(F.lit("crawler "), "task_id").alias("task_name"), "timestamp", F.col("id").cast("string").alias("progress_data"), F.col("event_type").alias("state_data")))


CHECKPOINTS = """points AS (SELECT task_id, 'crawler ' || task_id AS task_name, timestamp, CAST(id AS VARCHAR) AS progress_data, event_type AS state_data,
  row_number() OVER (PARTITION BY task_id ORDER BY timestamp DESC, CAST(id AS VARCHAR) DESC) AS place FROM logs),
checkpoints AS (SELECT *, task_id || '_' || CAST(epoch(date_trunc('second', timestamp)) AS BIGINT) AS checkpoint_id,
  md5('{"progress_data":"' || progress_data || '","state_data":"' || state_data || '","task_id":"' || task_id || '","task_name":"' || task_name || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '"}') AS checksum
  FROM points WHERE place <= 10)"""
register(
    "checkpoints_verified",
    lambda t: rec.verified_checkpoints(checkpoints(t).withColumn("state_data", F.when(F.col("progress_data").endswith("7"), "changed").otherwise(F.col("state_data")))).select("checkpoint_id", "progress_data", "checksum"),
    f"WITH {CHECKPOINTS} SELECT checkpoint_id, progress_data, checksum FROM checkpoints WHERE NOT ends_with(progress_data, '7')",
)
register(
    "checkpoints_removed",
    lambda t: rec.without_checkpoints(checkpoints(t), t.view("syncs").where("id % 50 < 5").select("task_id"), "task_id").select("checkpoint_id", "progress_data"),
    f"WITH {CHECKPOINTS} SELECT checkpoint_id, progress_data FROM checkpoints WHERE task_id NOT IN (SELECT task_id FROM syncs WHERE id % 50 < 5)",
)
register(
    "checkpoint_statistics",
    lambda t: rec.checkpoint_statistics(checkpoints(t)).select("total_checkpoints", "total_tasks"),
    f"WITH {CHECKPOINTS} SELECT COUNT(*) AS total_checkpoints, COUNT(DISTINCT task_id) AS total_tasks FROM checkpoints",
)


def attempts(t):
    strategy = F.when(F.col("id") % 4 == 0, "skip").when(F.col("id") % 4 == 1, "retry").otherwise("resume")
    return t.view("syncs").where("status = 'completed' AND id % 64 < 4").select(
        "id", "task_id", strategy.alias("strategy"), (F.col("id") % 3 == 0).alias("success"), F.when(F.col("id") % 2 == 0, "pending").otherwise("done").alias("status"), F.timestamp_seconds("start_time").alias("next_retry")
    )


def recovery_rows(t):
    kind = F.element_at(F.array(*map(F.lit, ("crawler run", "image_processing run", "data_sync run", "batch_processing run", "other"))), (F.col("id") % 5 + 1).cast("int"))
    what = F.when(F.col("id") % 3 == 0, "TimeoutError").when(F.col("id") % 3 == 1, "FatalError")
    failures = t.view("syncs").where("status = 'failed'").select("id", "task_id", kind.alias("task_name"), what.alias("exception_type"))
    return rec.recovery_plan(failures, attempts(t), checkpoints(t), retry_on=("Timeout",), stop_on=("Fatal",)).select("id", "task_type", "tries", "has_checkpoint", "strategy", "delay_s")


ATTEMPTS = """attempts AS (SELECT id, task_id, CASE id % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'retry' ELSE 'resume' END AS strategy, id % 3 = 0 AS success, CASE WHEN id % 2 = 0 THEN 'pending' ELSE 'done' END AS status, start_time
  FROM syncs WHERE status = 'completed' AND id % 64 < 4)"""
register(
    "recovery_plan",
    recovery_rows,
    f"""WITH {ATTEMPTS},
tries AS (SELECT task_id, COUNT(*) AS tries FROM attempts WHERE strategy <> 'skip' GROUP BY 1), saved AS (SELECT DISTINCT task_id, true AS has_checkpoint FROM logs),
config AS (SELECT * FROM (VALUES ('crawler', 5, 30, 1.5, 'resume', true), ('image_processing', 3, 60, 2.0, 'restart', false), ('data_sync', 10, 120, 2.0, 'resume', true), ('batch_processing', 3, 300, 2.0, 'restart', true), ('default', 3, 60, 2.0, 'retry', true)) v(task_type, most, delay, factor, own, uses)),
f AS (SELECT id, task_id, CASE id % 5 WHEN 0 THEN 'crawler' WHEN 1 THEN 'image_processing' WHEN 2 THEN 'data_sync' WHEN 3 THEN 'batch_processing' ELSE 'default' END AS task_type FROM syncs WHERE status = 'failed'),
j AS (SELECT id, task_type, coalesce(tries, 0) AS tries, coalesce(has_checkpoint, false) AS has_checkpoint, most, delay, factor, own, uses FROM f LEFT JOIN tries USING (task_id) LEFT JOIN saved USING (task_id) JOIN config USING (task_type))
SELECT id, task_type, tries, has_checkpoint, CASE WHEN id % 3 = 1 THEN 'stop' WHEN tries >= most THEN 'give_up' WHEN uses AND has_checkpoint THEN 'resume' WHEN id % 3 = 0 THEN 'retry' ELSE own END AS strategy,
  least(delay * pow(CAST(factor AS DOUBLE), tries), 3600) AS delay_s FROM j""",
)
register(
    "due_retries",
    lambda t: rec.due_retries(attempts(t), "1996-01-01 00:00:00").select("id", "task_id"),
    f"WITH {ATTEMPTS} SELECT id, task_id FROM attempts WHERE status = 'pending' AND start_time <= epoch(TIMESTAMP '1996-01-01')",
)
register(
    "recovery_statistics",
    lambda t: rec.recovery_statistics(attempts(t)),
    f"""WITH {ATTEMPTS} SELECT strategy, GROUPING(strategy) = 1 AS of_all, COUNT(DISTINCT task_id) AS tasks, COUNT(*) AS attempts, COUNT(*) FILTER (success) AS successful, COUNT(*) FILTER (NOT success) AS failed,
  COUNT(*) FILTER (success) * CAST(100 AS DOUBLE) / COUNT(*) AS success_percent FROM attempts GROUP BY ROLLUP (strategy)""",
)


def resumes(t):
    """Each tenth sync resumes the one of the number before it."""
    text = lambda c: c.cast("string")
    tasks = t.view("syncs").select(text(F.col("id")).alias("task_id"), rec.task_status(F.when(F.col("status") == "completed", "SUCCESS").when(F.col("status") == "failed", "FAILURE").otherwise("STARTED")).alias("status"))
    some = t.view("syncs").where("id % 10 < 2").select(
        text(F.col("id")).alias("new_task_id"), text(F.col("id") - 1).alias("original_task_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("c"), text(F.col("id")))).alias("checkpoint_id"), F.timestamp_seconds("start_time").alias("resumed_at")
    )
    return tasks, some


RESUMES = """tasks AS (SELECT CAST(id AS VARCHAR) AS task_id, CASE status WHEN 'completed' THEN 'success' WHEN 'failed' THEN 'failure' ELSE 'started' END AS status FROM syncs),
resumes AS (SELECT CAST(id AS VARCHAR) AS new_task_id, CAST(id - 1 AS VARCHAR) AS original_task_id, CASE WHEN id % 3 = 0 THEN 'c' || id END AS checkpoint_id FROM syncs WHERE id % 10 < 2),
known AS (SELECT resumes.*, coalesce(status, 'unknown') AS status FROM resumes LEFT JOIN tasks ON task_id = new_task_id)"""
register(
    "resume_status",
    lambda t: rec.resume_status(*resumes(t)).drop("resumed_at"),
    f"""WITH {RESUMES} SELECT new_task_id AS task_id, true AS is_resumed_task, original_task_id AS other_task_id, checkpoint_id, status FROM known
UNION ALL SELECT original_task_id, false, new_task_id, checkpoint_id, status FROM known WHERE original_task_id NOT IN (SELECT new_task_id FROM resumes)""",
)
register("open_resumes", lambda t: rec.open_resumes(*resumes(t)).select("new_task_id", "original_task_id"), f"WITH {RESUMES} SELECT new_task_id, original_task_id FROM known WHERE status NOT IN ('success', 'failure')")
register(
    "resume_statistics",
    lambda t: rec.resume_statistics(*resumes(t)).withColumn("success_rate", F.round("success_rate", 6)),
    f"""WITH {RESUMES} SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'success') AS completed, COUNT(*) FILTER (status = 'failure') AS failed, COUNT(checkpoint_id) AS with_checkpoint, COUNT(*) - COUNT(checkpoint_id) AS restarts,
  round(CAST(COUNT(*) FILTER (status = 'success') AS DOUBLE) / COUNT(*), 6) AS success_rate FROM known""",
)
register(
    "all_tasks",
    lambda t: rec.all_tasks(t.view("syncs").where("status = 'running'").select("id", "task_id", "start_time"), t.view("syncs").where("status <> 'running'").select("id", "task_id", "duration")),
    "SELECT id, task_id, CASE WHEN status = 'running' THEN start_time END AS start_time, CASE WHEN status <> 'running' THEN duration END AS duration FROM syncs",
)

register(
    "rows_serialised",
    lambda t: rows.serialised(t.view("logs").select("id", "timestamp", "level", "message"), "message"),
    "SELECT id, CASE WHEN date_part('microsecond', timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp, level FROM logs",
)
register(
    "rows_updated",
    lambda t: rows.updated_from(t.view("products").select("id", "title", "status"), t.view("products").where("id % 3 = 0").select("id", F.lit("changed").alias("status"), F.lit(1).alias("unknown")), "id", AS_OF_LOGS).select("id", "title", "status", text_time("updated_at")),
    f"SELECT id, title, CASE WHEN id % 3 = 0 THEN 'changed' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN '{AS_OF_LOGS}' END AS updated_at FROM products",
)
register(
    "sync_performance",
    lambda t: rows.sync_performance(t.view("syncs")).select("id", "task_id", "success_rate", "records_per_second", "progress_percent", "remaining_s"),
    f"""SELECT id, task_id, {RATE.format('success_count', 2)} AS success_rate, CASE WHEN duration > 0 THEN processed_count // duration ELSE 0 END AS records_per_second,
  processed_count * CAST(100 AS DOUBLE) / total_count AS progress_percent, CAST(0 AS BIGINT) AS remaining_s FROM syncs""",
)
register(
    "log_entries",
    lambda t: rows.log_entries(t.view("logs"), ("task_id", "user_id"), ("error_type",)),
    """SELECT id, '{"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '","level":"' || level || '","message":"' || message || '","context":{"task_id":"' || task_id || '","user_id":' || user_id || '}'
  || CASE WHEN error_type IS NULL THEN '' ELSE ',"error":{"error_type":"' || error_type || '"}' END || '}' AS entry FROM logs""",
)
register(
    "failure_logs",
    lambda t: rows.failure_logs(t.view("products").where("status = 'inactive'").select(F.create_map(F.lit("id"), "source_id").alias("item"), F.col("brand").alias("reason")), AS_OF_LOGS, "crawl").select("task_id", "level", "message", F.col("details")["id"].alias("item"), "success"),
    f"SELECT 'crawl_' || strftime(TIMESTAMP '{AS_OF_LOGS}', '%Y%m%d_%H%M%S') AS task_id, 'ERROR' AS level, 'save failed: ' || brand AS message, source_id AS item, false AS success FROM products WHERE status = 'inactive'",
)


def responses(t):
    status = F.when(F.col("id") % 11 == 0, 404).otherwise(200)
    return t.view("images").select("id", F.col("id").cast("string").alias("url"), "product_id", "image_type", status.alias("http_status"), F.when(F.col("id") % 7 == 0, "text/html").otherwise("image/PNG").alias("content_type"), "size", F.md5(F.col("id").cast("string")).alias("checksum"))


RESPONSES = """r AS (SELECT id, CAST(product_id AS VARCHAR) AS p, image_type, size, CASE WHEN id % 11 = 0 THEN 'HTTP 404' WHEN id % 7 = 0 THEN 'not a picture: text/html' WHEN size > 40000 THEN 'too large: ' || size END AS error FROM images)"""
register(
    "download_results",
    lambda t: rows.download_results(responses(t), 40_000).select("id", "status", "path", "error", "image_type"),
    f"WITH {RESPONSES} SELECT id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN error IS NULL THEN p[1:2] || '/' || p || '/' || md5(CAST(id AS VARCHAR)) || '.png' END AS path, error, image_type FROM r",
)
register(
    "batch_rollup",
    lambda t: rows.batch_rollup(rows.download_results(responses(t), 40_000).select("image_type", (F.col("status") == "completed").alias("success"), F.col("size").alias("bytes_before"), (F.col("size") - F.col("id") % 1000).alias("bytes_after")), "image_type")
    .withColumn("avg_saved_percent", F.round("avg_saved_percent", 4)),
    f"""WITH {RESPONSES} SELECT image_type, COUNT(*) AS total, COUNT(*) FILTER (error IS NULL) AS successful, COUNT(*) FILTER (error IS NOT NULL) AS failed, coalesce(CAST(SUM(id % 1000) FILTER (error IS NULL) AS BIGINT), 0) AS bytes_saved,
  round(CAST(SUM(CAST((id % 1000) * CAST(100 AS DOUBLE) / size AS DECIMAL(18,6))) FILTER (error IS NULL) AS DOUBLE) / COUNT(*) FILTER (error IS NULL), 4) AS avg_saved_percent,
  COUNT(*) FILTER (error IS NULL) * CAST(100 AS DOUBLE) / COUNT(*) AS success_percent FROM r GROUP BY 1""",
)
register(
    "pool_advice",
    lambda t: rows.pool_advice(t.view("syncs").select("id", F.lit(100).alias("size"), F.col("processed_count").alias("used"), F.greatest(F.col("failed_count") - 15, F.lit(0)).alias("overflow"))).select("id", F.array_join("advice", ",").alias("advice")),
    """SELECT id, concat_ws(',', CASE WHEN u > 0.8 THEN 'grow' WHEN u < 0.2 THEN 'shrink' END, CASE WHEN o > 0 THEN 'raise_overflow' END) AS advice
FROM (SELECT id, greatest(failed_count - 15, 0) AS o, CAST(processed_count AS DOUBLE) / (100 + greatest(failed_count - 15, 0)) AS u FROM syncs)""",
)
register(
    "performance_advice",
    lambda t: rows.performance_advice(t.view("syncs").select("id", F.col("processed_count").alias("memory_percent"), F.col("success_count").alias("cpu_percent"), (F.col("processed_count") / 100).alias("hit_rate"), (F.col("duration") / 400).alias("avg_query_s")))
    .select("id", F.array_join(F.transform("advice", lambda a: a["category"]), ",").alias("advice")),
    """SELECT id, concat_ws(',', CASE WHEN processed_count > 80 THEN 'memory' END, CASE WHEN success_count > 80 THEN 'cpu' END, CASE WHEN processed_count < 50 THEN 'cache' END, CASE WHEN duration > 400 THEN 'database' END) AS advice FROM syncs""",
)
register(
    "duplicate_statistics",
    lambda t: rows.duplicate_statistics(t.view("products").groupBy("brand", "category_name").agg(F.count("*").alias("size")).where("size > 1").withColumn("similarity", F.lit(1.0) / F.col("size"))),
    """WITH g AS (SELECT COUNT(*) AS size FROM products GROUP BY brand, category_name HAVING COUNT(*) > 1)
SELECT COUNT(*) AS total_groups, coalesce(CAST(SUM(size) AS BIGINT), 0) AS total_records, coalesce(CAST(SUM(size) AS BIGINT), 0) - COUNT(*) AS duplicate_records, coalesce(CAST(SUM(size) - COUNT(*) AS DOUBLE) / SUM(size), 0) AS duplicate_ratio,
  coalesce(round(CAST(SUM(CAST(CAST(1 AS DOUBLE) / size AS DECIMAL(18,6))) AS DOUBLE) / COUNT(*), 3), 0) AS average_similarity FROM g""",
)
register(
    "missing_ids",
    lambda t: rows.missing_ids(t.lineitem.select(F.col("l_partkey").alias("id")), t.view("products").where("status = 'active'"), "id"),
    "SELECT COUNT(*) AS wanted, COUNT(id) AS found, COUNT(*) = COUNT(id) AS complete FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN (SELECT id FROM products WHERE status = 'active') ON l_partkey = id",
)
