"""Streams with state: progress of tasks, alerts and error groups, each against SQL over all events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import events as stream
from ..streaming import metrics, notify, states
from .operations import SHOWN_TIME, text_time
from .registry import registry
from .time import stream_folder

QUERIES, ORACLE_SQL, register = registry()
#: Later than any event by more than any state lives.
CLOSING = dt.datetime(2100, 1, 1)


def run_all(t, fold: states.Fold, rows) -> DataFrame:
    """All events through the fold, stopped once and started again for the closing mark."""
    run = states.Run(t.spark, stream_folder(t.spark), lambda: rows(stream.event_stream(t.spark, t.folder)), fold)
    run.go()
    run.mark_at(CLOSING)
    run.go()
    return run.states()


def steps(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("event_id").cast("double").alias("current"), F.lit(1e6).alias("total"), status.alias("status"))


def rules(events: DataFrame) -> DataFrame:
    what = F.when(F.col("event_type") == "error", "fire").when(F.col("event_type") == "signup", "acknowledge").when(F.col("event_id") % 37 == 0, "resolve")
    return events.select(F.concat(F.lit("task-"), (F.col("user_id") % 20).cast("string")).alias("key"), "ts", F.col("event_id").alias("id"), what.alias("what"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("who")).where("what IS NOT NULL")


def groups(events: DataFrame) -> DataFrame:
    what = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 11 == 0, "resolved")
    key = F.md5(F.concat(F.lit("E"), (F.col("user_id") % 97).cast("string")))
    return events.select(key.alias("key"), "ts", F.col("event_id").alias("id"), what.alias("what")).where("what IS NOT NULL")


GAP = "SUM(CASE WHEN {ended} AND ts - lag(ts) OVER k > INTERVAL {hours} HOURS THEN 1 ELSE 0 END) OVER k"
register(
    "stream_task_progress",
    lambda t: run_all(t, states.PROGRESS, steps).select("key", text_time("since").alias("since"), "points", "current", "status", "removed", *[F.round(c, 6).alias(c) for c in ("avg_speed", "instant_speed")], F.round("seconds_left", 0).cast("long").alias("seconds_left")),
    f"""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(ts AS TIMESTAMP) AS ts, event_id AS id, CAST(event_id AS DOUBLE) AS current, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events),
e AS (SELECT *, coalesce(lag(ts) OVER k < ts - INTERVAL 1 HOUR AND lag(status) OVER k <> 'running', false) AS cut FROM s WINDOW k AS (PARTITION BY key ORDER BY ts, id)),
g AS (SELECT *, SUM(CAST(cut AS INT)) OVER (PARTITION BY key ORDER BY ts, id) AS life FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY key, life ORDER BY ts DESC, id DESC) AS back FROM g),
a AS (SELECT key, MIN(ts) AS since, COUNT(*) AS points, MAX(current) FILTER (back = 1) AS current, MAX(status) FILTER (back = 1) AS status,
  MAX(epoch_us(ts)) FILTER (back = 1) AS t1, MIN(epoch_us(ts)) FILTER (back <= 10) AS t10, MIN(epoch_us(ts)) FILTER (back = 3) AS t3, arg_min(current, back) FILTER (back = 1) AS c1, arg_max(current, back) FILTER (back <= 10) AS c10, MAX(current) FILTER (back = 3) AS c3 FROM r GROUP BY key, life),
v AS (SELECT *, (c1 - c10) / nullif((t1 - t10) / CAST(1000000 AS DOUBLE), 0) AS speed FROM a)
SELECT key, {SHOWN_TIME.format('since')} AS since, CAST(points AS INT) AS points, current, status, status <> 'running' AS removed, round(speed, 6) AS avg_speed,
  round((c1 - c3) / nullif((t1 - t3) / CAST(1000000 AS DOUBLE), 0), 6) AS instant_speed, CASE WHEN speed > 0 AND current < 1000000 THEN CAST(round((1000000 - current) / speed, 0) AS BIGINT) END AS seconds_left FROM v""",
)
register(
    "stream_alerts",
    lambda t: run_all(t, states.alerts_fold(7200.0), rules).select(F.col("key").alias("rule_id"), text_time("triggered_at").alias("triggered_at"), "fires", "sent", "status", text_time("acknowledged_at").alias("acknowledged_at"), "acknowledged_by", text_time("resolved_at").alias("resolved_at"), "resolved_by"),
    f"""WITH RECURSIVE h AS (SELECT task_id AS rule_id, timestamp, id, CASE WHEN event_type = 'error' THEN 'fire' WHEN event_type = 'signup' THEN 'acknowledge' WHEN id % 37 = 0 THEN 'resolve' END AS what, 'u' || user_id AS who FROM logs),
p AS (SELECT *, coalesce(SUM(CASE WHEN what = 'resolve' THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM h WHERE what IS NOT NULL),
o AS (SELECT rule_id, part, MIN((timestamp, id)) AS opened FROM p WHERE what = 'fire' GROUP BY 1, 2),
f AS (SELECT rule_id, part, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY rule_id, part ORDER BY timestamp, id) AS n FROM p WHERE what = 'fire'),
c AS (SELECT rule_id, part, n, true AS sent, t AS last FROM f WHERE n = 1
  UNION ALL SELECT f.rule_id, f.part, f.n, f.t - c.last >= 7200000000, CASE WHEN f.t - c.last >= 7200000000 THEN f.t ELSE c.last END FROM c JOIN f ON f.n = c.n + 1 AND f.rule_id = c.rule_id AND f.part = c.part),
x AS (SELECT rule_id, part, CAST(COUNT(*) FILTER (sent) AS INT) AS sent FROM c GROUP BY 1, 2),
g AS (SELECT rule_id, part, MIN(timestamp) AS t, CAST(COUNT(*) FILTER (what = 'fire') AS INT) AS fires, arg_max(timestamp, (timestamp, id)) FILTER (what = 'acknowledge') AS a, arg_max(who, (timestamp, id)) FILTER (what = 'acknowledge') AS aw,
  arg_max(timestamp, (timestamp, id)) FILTER (what = 'resolve') AS e, arg_max(who, (timestamp, id)) FILTER (what = 'resolve') AS ew FROM p JOIN o USING (rule_id, part) WHERE (timestamp, id) >= opened GROUP BY 1, 2)
SELECT rule_id, {SHOWN_TIME.format('t')} AS triggered_at, fires, sent, CASE WHEN e IS NOT NULL THEN 'resolved' WHEN a IS NOT NULL THEN 'acknowledged' ELSE 'active' END AS status,
  {SHOWN_TIME.format('a')} AS acknowledged_at, aw AS acknowledged_by, {SHOWN_TIME.format('e')} AS resolved_at, ew AS resolved_by FROM g JOIN x USING (rule_id, part)""",
)
register(
    "stream_error_groups",
    lambda t: run_all(t, states.ERROR_GROUPS, groups).select(F.col("key").alias("fingerprint"), text_time("since").alias("since"), text_time("last_seen").alias("last_seen"), "occurrences", "status", "reopened", "removed"),
    f"""WITH RECURSIVE s AS (SELECT md5('E' || (user_id % 97)) AS key, CAST(ts AS TIMESTAMP) AS ts, event_id AS id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'resolved' END AS what FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n FROM s WHERE what IS NOT NULL),
r AS (SELECT key, n, ts AS last, what = 'error' AS live, CASE WHEN what = 'error' THEN ts END AS since, CAST(what = 'error' AS INT) AS occurrences, 'open' AS status, 0 AS reopened FROM w WHERE n = 1
  UNION ALL SELECT w.key, w.n, w.ts, CASE WHEN r.live AND w.ts - r.last <= INTERVAL 24 HOURS THEN true ELSE w.what = 'error' END,
    CASE WHEN r.live AND w.ts - r.last <= INTERVAL 24 HOURS THEN r.since WHEN w.what = 'error' THEN w.ts END,
    CASE WHEN r.live AND w.ts - r.last <= INTERVAL 24 HOURS THEN r.occurrences ELSE 0 END + CAST(w.what = 'error' AS INT),
    CASE WHEN w.what = 'error' THEN 'open' ELSE w.what END,
    CASE WHEN r.live AND w.ts - r.last <= INTERVAL 24 HOURS THEN r.reopened + CAST(w.what = 'error' AND r.status <> 'open' AS INT) ELSE 0 END
  FROM r JOIN w ON w.key = r.key AND w.n = r.n + 1)
SELECT key AS fingerprint, {SHOWN_TIME.format('since')} AS since, {SHOWN_TIME.format('MAX(last)')} AS last_seen, arg_max(occurrences, n) AS occurrences, arg_max(status, n) AS status, arg_max(reopened, n) AS reopened, true AS removed
FROM r WHERE live GROUP BY key, since""",
)


def collected(t) -> DataFrame:
    events = stream.event_stream(t.spark, t.folder)
    return metrics.levels(stream.run_to_end(metrics.histograms(events, "event_type"), "update", stream_folder(t.spark), ["start", "event_type"]), "event_type")


BOUNDS = ", ".join(f"CAST({b:g} AS DOUBLE)" for b in metrics.BOUNDS)
register(
    "stream_metric_levels",
    lambda t: collected(t).select("level", text_time("start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"), "least", "most", *[F.round(metrics.quantile(q), 6).alias(name) for name, q in (("median", 0.5), ("p95", 0.95))]),
    f"""WITH l AS (SELECT unnest(['minute', 'hour', 'day']) AS level), e AS (SELECT level, date_trunc(level, ts) AS start, event_type, value, len(list_filter([{BOUNDS}], lambda b: b < value)) AS cell FROM events, l WHERE value IS NOT NULL),
b AS (SELECT level, start, event_type, cell, COUNT(*) AS c FROM e GROUP BY 1, 2, 3, 4),
r AS (SELECT *, SUM(c) OVER (PARTITION BY level, start, event_type ORDER BY cell) AS upto FROM b),
g AS (SELECT level, start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total, MIN(value) AS least, MAX(value) AS most FROM e GROUP BY 1, 2, 3),
q AS (SELECT g.*, share, (SELECT arg_min((cell, c, upto), cell) FROM r WHERE r.level = g.level AND r.start = g.start AND r.event_type = g.event_type AND upto >= n * share) AS x FROM g, (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.95 AS DOUBLE)]) AS share)),
v AS (SELECT *, CASE WHEN x[1] = 0 THEN CAST(0 AS DOUBLE) ELSE [{BOUNDS}][x[1]] END AS low, [{BOUNDS}][x[1] + 1] AS high FROM q)
SELECT level, {SHOWN_TIME.format('start')} AS start, event_type, MAX(n) AS n, MAX(total) AS total, MAX(least) AS least, MAX(most) AS most,
  round(MAX(coalesce(low + (high - low) * (n * share - (x[3] - x[2])) / x[2], low)) FILTER (share = 0.5), 6) AS median, round(MAX(coalesce(low + (high - low) * (n * share - (x[3] - x[2])) / x[2], low)) FILTER (share = 0.95), 6) AS p95 FROM v GROUP BY 1, 2, 3""",
)


def notified(t) -> DataFrame:
    """Errors of all events as messages in the log, read back."""
    folder = stream_folder(t.spark)
    rows = stream.event_stream(t.spark, t.folder).where("event_type = 'error'").select("event_id", F.concat(F.lit("error of user "), F.col("user_id").cast("string")).alias("message"))
    notify.send(rows, f"{folder}/messages", f"{folder}/checkpoint")
    return notify.sent(t.spark, f"{folder}/messages", "event_id long, message string").drop("batch")


register("stream_notifications", notified, "SELECT event_id, 'error of user ' || user_id AS message FROM events WHERE event_type = 'error'")
