"""Operating figures: request and query metrics, histograms, memory, workers, queues, application metrics, alerts' life cycle and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.model import percent
from .series import seconds, sent_alerts
from .statistics import exact_avg, exact_sum

# Limits (warning, critical) of the queues' health, active tasks of a degraded worker, trend of memory in MB a minute.
QUEUE_LIMITS = {"error_rate": (0.05, 0.15), "avg_wait": (60.0, 180.0), "pending": (1000.0, 5000.0)}
DEGRADED_TASKS, MEMORY_TREND = 100, 1.0


def since(at: str, as_of: str, span_s: int) -> Column:
    """Whether the timestamp lies in the last span_s seconds up to as_of."""
    ago = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))
    return F.coalesce(ago.between(0, span_s), F.lit(False))


def request_metrics(requests: DataFrame) -> DataFrame:
    """id, timestamp, metric, kind, value, tags: a counter and three histograms for each request; null values stay."""
    tags = F.create_map(F.lit("endpoint"), F.col("endpoint"), F.lit("method"), F.col("method"))
    counted = F.map_concat(tags, F.create_map(F.lit("status"), F.col("status_code").cast("string")))
    rows = [F.struct(F.lit("request_count").alias("metric"), F.lit("counter").alias("kind"), F.lit(1.0).alias("value"), counted.alias("tags"))]
    for metric, column in (("request_response_time", "response_time"), ("request_size", "request_size"), ("response_size", "response_size")):
        rows.append(F.struct(F.lit(metric).alias("metric"), F.lit("histogram").alias("kind"), F.col(column).cast("double").alias("value"), tags.alias("tags")))
    return requests.select("id", "timestamp", F.inline(F.array(*rows)))


def application_metrics(points: DataFrame, uptime_s: float) -> DataFrame:
    """One row of points(name, kind, value, timestamp, id): request rate, error share and mean duration of requests, tasks and queue depths.

    Counters are added up, gauges count by their newest point, timers by their mean; what has no point is 0.
    """
    counter = lambda name: F.coalesce(exact_sum(F.when((F.col("kind") == "counter") & (F.col("name") == name), F.col("value")), 6), F.lit(0.0))
    gauge = lambda name: F.coalesce(F.max_by(F.col("value"), F.when((F.col("kind") == "gauge") & (F.col("name") == name), F.struct("timestamp", "id"))), F.lit(0.0))
    timed = F.when((F.col("kind") == "timer") & (F.col("name") == "request_duration"), F.col("value"))
    out = points.agg(
        *[counter(n).alias(n) for n in ("total_requests", "error_count", "completed_tasks", "failed_tasks")],
        *[gauge(n).alias(n) for n in ("active_requests", "active_tasks", "queue_default_depth", "queue_crawler_depth", "queue_image_processing_depth", "queue_data_sync_depth")],
        F.coalesce(exact_avg(timed, 6), F.lit(0.0)).alias("avg_response_time"),
    )
    rate = F.col("total_requests") / F.lit(float(uptime_s)) if uptime_s > 0 else F.lit(0.0)
    return out.withColumn("request_rate", rate).withColumn("error_rate", F.coalesce(F.try_divide("error_count", "total_requests"), F.lit(0.0)))


def query_statistics(queries: DataFrame, *keys: str, slow_s: float = 1.0) -> DataFrame:
    """Queries(execution_time, success) by outcome, success share, mean and longest time of successful ones (0 without any), slow ones."""
    good = F.when(F.col("success"), F.col("execution_time"))
    out = queries.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("success").alias("successful"), F.coalesce(exact_avg(good, 6), F.lit(0.0)).alias("avg_time"),
        F.coalesce(F.max(good), F.lit(0.0)).alias("max_time"), F.count_if(F.col("execution_time") > slow_s).alias("slow"),
    )
    return out.withColumn("failed", F.col("total") - F.col("successful")).withColumn("success_rate", F.coalesce(F.try_divide("successful", "total"), F.lit(0.0)))


def memory_trend(points: DataFrame, as_of: str, *keys: str, minutes: int = 30) -> DataFrame:
    """First and last memory of the last minutes, change and change a minute, and the trend; under two points insufficient_data."""
    order = F.struct("timestamp", "id")
    out = points.where(since("timestamp", as_of, minutes * 60)).groupBy(*keys).agg(
        F.count("*").alias("points"), F.min_by("memory_mb", order).alias("start_mb"), F.max_by("memory_mb", order).alias("end_mb")
    )
    out = out.withColumn("change_mb", F.col("end_mb") - F.col("start_mb")).withColumn("change_mb_per_min", F.col("change_mb") / F.lit(float(minutes)))
    rate = F.col("change_mb_per_min")
    trend = F.when(F.col("points") < 2, "insufficient_data").when(rate > MEMORY_TREND, "increasing").when(rate < -MEMORY_TREND, "decreasing").otherwise("stable")
    return out.withColumn("trend", trend)


def snapshot_difference(snapshots: DataFrame, key: str, *fields: str) -> DataFrame:
    """snapshots with <field>_change: the difference to the key's snapshot before (timestamp, id); null for its first."""
    before = W.partitionBy(key).orderBy("timestamp", "id")
    return snapshots.withColumns({f"{f}_change": F.col(f) - F.lag(f).over(before) for f in fields})


def worker_status(workers: DataFrame, tasks: DataFrame) -> DataFrame:
    """worker_name, total_tasks, active_tasks and status: stopped if it doesn't answer, degraded above DEGRADED_TASKS, else running."""
    active = tasks.where("status = 'running'").groupBy("worker_name").agg(F.count("*").alias("active_tasks"))
    out = workers.join(active, "worker_name", "left").withColumn("active_tasks", F.coalesce("active_tasks", F.lit(0)))
    status = F.when(~F.coalesce(F.col("answers"), F.lit(False)), "stopped").when(F.col("active_tasks") > DEGRADED_TASKS, "degraded").otherwise("running")
    return out.select("worker_name", "total_tasks", "active_tasks", status.alias("status"))


def queue_health(queues: DataFrame, workers: DataFrame) -> DataFrame:
    """One row from queue_status and worker_status: shares, mean wait, findings and the status ladder critical, warning, healthy."""
    from_workers = workers.agg(F.coalesce(F.sum("active_tasks"), F.lit(0)).alias("active"), F.count_if(F.col("status") == "stopped").alias("stopped_workers"))
    summed = queues.agg(
        F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.coalesce(exact_avg("avg_wait", 6), F.lit(0.0)).alias("avg_wait")
    )
    out = summed.join(F.broadcast(from_workers))  # one row each
    total = F.col("active") + F.col("pending") + F.col("failed")
    out = out.withColumn("error_rate", F.coalesce(F.try_divide("failed", total), F.lit(0.0)))
    out = out.withColumn("success_rate", F.coalesce(F.try_divide(F.col("active") + F.col("pending"), total), F.lit(1.0)))
    over = lambda i: [(name, F.col(name) > limits[i]) for name, limits in QUEUE_LIMITS.items()]
    found = [F.when(hard, f"{name}_critical").when(soft, f"{name}_warning") for (name, soft), (_, hard) in zip(over(0), over(1))]
    found.append(F.when(F.col("stopped_workers") > 0, "workers_stopped"))
    alerts = F.filter(F.array(*found), lambda x: x.isNotNull())
    critical = F.exists("alerts", lambda a: a.endswith("_critical"))
    status = F.when(critical, "critical").when(F.size("alerts") > 0, "warning").otherwise("healthy")
    return out.withColumn("alerts", alerts).withColumn("status", status)


def instant_rate(points: DataFrame, key: str, as_of: str, window_s: int) -> DataFrame:
    """key, rate: a counter's increase a second between its last two points in the window; a reset counts from 0, one point gives none.

    The last two points are found by aggregation, so a hot key is combined before the shuffle.
    """
    order = lambda: F.struct(seconds("timestamp").alias("t"), F.col("id").alias("id"), F.col("value").cast("double").alias("v"))
    near = points.where(since("timestamp", as_of, window_s)).select(key, order().alias("p"))
    newest = near.groupBy(key).agg(F.max("p").alias("new"))
    before = near.join(newest.select(F.col(key).alias("__k"), "new"), F.col(key).eqNullSafe(F.col("__k"))).where("p < new").groupBy(key).agg(F.max("p").alias("old"), F.first("new").alias("new"))
    rise = F.when(F.col("new.v") >= F.col("old.v"), F.col("new.v") - F.col("old.v")).otherwise(F.col("new.v"))
    return before.select(key, F.try_divide(rise, F.col("new.t") - F.col("old.t")).alias("rate"))


def histogram_buckets(points: DataFrame, bounds: list[float], *keys: str) -> DataFrame:
    """keys, le, n: how many values are at most each bound, the last one infinite."""
    sums = [F.count_if(F.col("value") <= b).alias(f"__{i}") for i, b in enumerate(bounds)]
    wide = points.where("value IS NOT NULL").groupBy(*keys).agg(*sums, F.count("*").alias("__all"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"__{i}").alias("n")) for i, b in enumerate(bounds)]
    return wide.select(*keys, F.inline(F.array(*rows, F.struct(F.lit(float("inf")).alias("le"), F.col("__all").alias("n")))))


def histogram_quantile(buckets: DataFrame, share: float, *keys: str) -> DataFrame:
    """keys, quantile from cumulative buckets(le, n), in proportion within a bucket; the first starts at 0, the infinite one gives its lower bound."""
    ordered = F.array_sort(F.collect_list(F.struct("le", F.col("n").cast("double").alias("n"))))
    rows = buckets.groupBy(*keys).agg(ordered.alias("b"))  # as many entries as bounds
    rank = F.element_at("b", -1)["n"] * F.lit(share)
    rows = rows.withColumn("rank", rank).withColumn("at", F.size(F.filter("b", lambda x: x["n"] < F.col("rank"))))
    here, below = F.col("b")[F.col("at")], F.when(F.col("at") > 0, F.get("b", F.col("at") - 1))
    low, count_low = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["n"], F.lit(0.0))
    inside = low + (here["le"] - low) * F.try_divide(F.col("rank") - count_low, here["n"] - count_low)
    return rows.select(*keys, F.when(F.element_at("b", -1)["n"] > 0, F.when(here["le"] == F.lit(float("inf")), low).otherwise(inside)).alias("quantile"))


def alert_cycle(happened: DataFrame, cooldown_s: float = 300.0) -> DataFrame:
    """Alerts with their life cycle, from happened(rule_id, timestamp, id, what, who) with what: fire, acknowledge or resolve.

    A rule's first fire, or the first after a resolve, opens an alert; later ones belong to it. It is sent at opening and at each fire that
    comes cooldown_s or more after the last sending. The last acknowledge while open marks it, a resolve ends it. Acknowledges and resolves
    without an open alert do nothing. Ties go by id. Returns rule_id, episode, triggered_at, fires, sent, status, acknowledged_at,
    acknowledged_by, resolved_at, resolved_by. A rule's events are numbered in one sort that spills, kept rows are only its alerts.
    """
    order = W.partitionBy("rule_id").orderBy("timestamp", "id")
    ended = F.sum(F.when(F.col("what") == "resolve", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = happened.withColumn("__part", F.coalesce(ended, F.lit(0)))
    opened = F.min(F.when(F.col("what") == "fire", F.struct("timestamp", "id"))).over(W.partitionBy("rule_id", "__part"))
    rows = rows.withColumn("__open", opened).where(F.struct("timestamp", "id") >= F.col("__open"))
    fired = rows.where("what = 'fire'").select("id", "timestamp", F.concat_ws("|", "rule_id", F.col("__part").cast("string")).alias("__alert"))
    sent = sent_alerts(fired, "__alert", "timestamp", "id", cooldown_s).where("sent").groupBy("__alert").agg(F.count("*").alias("sent"))
    at = lambda what: F.when(F.col("what") == what, F.struct("timestamp", "id", "who"))
    alerts = rows.groupBy("rule_id", "__part").agg(
        F.min("__open").alias("__open"), F.count_if(F.col("what") == "fire").alias("fires"), F.max(at("acknowledge")).alias("__ack"), F.max(at("resolve")).alias("__end")
    )
    alerts = alerts.withColumn("__alert", F.concat_ws("|", "rule_id", F.col("__part").cast("string"))).join(sent, "__alert")
    number = F.row_number().over(W.partitionBy("rule_id").orderBy("__part"))
    status = F.when(F.col("__end").isNotNull(), "resolved").when(F.col("__ack").isNotNull(), "acknowledged").otherwise("active")
    return alerts.select(
        "rule_id", number.alias("episode"), F.col("__open.timestamp").alias("triggered_at"), "fires", "sent", status.alias("status"),
        F.col("__ack.timestamp").alias("acknowledged_at"), F.col("__ack.who").alias("acknowledged_by"), F.col("__end.timestamp").alias("resolved_at"), F.col("__end.who").alias("resolved_by"),
    )


def log_rule(logs: DataFrame, as_of: str, span_s: int, at_least: int, level: str = "ERROR", holds: str | None = None) -> DataFrame:
    """One row, n and firing: logs of a level in the span whose message holds the text (any without one)."""
    match = since("timestamp", as_of, span_s) & (F.col("level") == level)
    if holds is not None:
        match = match & F.col("message").contains(holds)
    return logs.agg(F.count_if(match).alias("n")).withColumn("firing", F.col("n") >= at_least)


def error_rule(errors: DataFrame, as_of: str, span_s: int, at_least: int, error_type: str | None = None, severity: str | None = None) -> DataFrame:
    """One row, n and firing: errors of the last span_s seconds, of a type, else of a severity, else all."""
    match = since("timestamp", as_of, span_s)
    if error_type is not None:
        match = match & (F.col("error_type") == error_type)
    elif severity is not None:
        match = match & (F.col("severity") == severity)
    return errors.agg(F.count_if(match).alias("n")).withColumn("firing", F.col("n") >= at_least)


def error_statistics(errors: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """field (severity, error_type, status, all), value, n, per_hour and share in percent of the errors of the last hours."""
    recent = errors.where(since("timestamp", as_of, hours * 3600)).select("severity", "error_type", "status")
    cells = recent.groupBy("severity", "error_type", "status").agg(F.count("*").alias("__n"))
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("severity", "error_type", "status")]
    long = cells.select("__n", F.inline(F.array(*parts, F.struct(F.lit("all").alias("field"), F.lit(None).cast("string").alias("value")))))
    counted = long.groupBy("field", "value").agg(F.sum("__n").alias("n"))
    total = recent.agg(F.count("*").alias("__total"))  # one row
    out = counted.join(F.broadcast(total)).withColumn("per_hour", F.try_divide("n", F.lit(float(hours))))
    return out.withColumn("share_percent", percent(F.col("n"), F.col("__total"))).drop("__total")


def error_events(errors: DataFrame, closed: DataFrame) -> DataFrame:
    """A row for each fingerprint of errors(fingerprint, error_type, severity, timestamp, id), with what closed(fingerprint, timestamp, status) set.

    Type and severity are the first occurrence's. The status is that of the newest closing, unless the error came again after it: then it is
    open, and reopened is true. Ties: the closing wins.
    """
    order = F.struct("timestamp", "id")
    found = errors.groupBy("fingerprint").agg(
        F.count("*").alias("occurrences"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.min_by("error_type", order).alias("error_type"), F.min_by("severity", order).alias("severity"),
    )
    last = closed.groupBy("fingerprint").agg(F.max(F.struct("timestamp", "status")).alias("__closed"))
    again = F.col("last_seen") > F.col("__closed.timestamp")
    out = found.join(last, "fingerprint", "left")
    status = F.when(F.col("__closed").isNull() | again, "open").otherwise(F.col("__closed.status"))
    return out.withColumn("status", status).withColumn("reopened", F.coalesce(again, F.lit(False))).drop("__closed")


def errors_having(events: DataFrame, status: str | None = None, severity: str | None = None, at_least: int = 1, most: int = 100) -> DataFrame:
    """The most recent error events of a status, severity and number of occurrences."""
    out = events.where(F.col("occurrences") >= at_least)
    out = out.where(F.col("status") == status) if status is not None else out
    out = out.where(F.col("severity") == severity) if severity is not None else out
    return out.orderBy(F.desc("last_seen"), "fingerprint").limit(most)


def log_insights(logs: DataFrame, as_of: str, hours: int = 24, many: int = 10_000) -> DataFrame:
    """One row for the last hours: total, errors, error_rate, insights and the advice that goes with them."""
    recent = logs.where(since("timestamp", as_of, hours * 3600))
    out = recent.agg(F.count("*").alias("total"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"))
    out = out.withColumn("error_rate", F.coalesce(F.try_divide("errors", "total"), F.lit(0.0)))
    any_ = F.col("total") > 0
    found = F.array(
        F.when(~any_, "no_logs"), F.when(any_ & (F.col("error_rate") > 0.1), "error_rate_high"), F.when(any_ & (F.col("error_rate") < 0.01), "error_rate_very_low"),
        F.when(F.col("total") > many, "many_logs"),
    )
    out = out.withColumn("insights", F.filter(found, lambda x: x.isNotNull()))
    advice = F.array(F.when(F.array_contains("insights", "error_rate_high"), "look for the cause and add alerts"), F.when(F.array_contains("insights", "many_logs"), "raise the log level or aggregate logs"))
    return out.withColumn("advice", F.filter(advice, lambda x: x.isNotNull()))
