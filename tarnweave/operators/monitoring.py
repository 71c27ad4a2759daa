"""Metrics, requests, log patterns, errors and alert rules in batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.model import percent
from ..functions.text import error_fingerprint, log_pattern
from . import ranks
from .statistics import ERRORS, exact_avg

#: Detail keys of a performance log that hold metrics.
METRIC_KEYS = ("duration_ms", "response_time", "execution_time", "throughput", "cpu_usage", "memory_usage")
RULES = "rule_id string, name string, metric string, aggregate string, operator string, threshold double, window_s long, level string"


def metric_summary(points: DataFrame, *keys: str) -> DataFrame:
    """Count, min, max, mean and latest value; points: value, timestamp, id (breaks ties)."""
    return points.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), exact_avg("value", 6).alias("avg_value"), F.max_by("value", F.struct("timestamp", "id")).alias("latest"))


def percentiles(points: DataFrame, *keys: str) -> DataFrame:
    """Median, 95th and 99th percentile with linear interpolation, exactly; keys without values are left out."""
    return ranks.percentiles(points, list(keys), {"median": 0.5, "p95": 0.95, "p99": 0.99})


def nearest_rank(points: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """Value number floor(n * share), from 0, of each key's sorted values."""
    return ranks.nearest_ranks(points, [key], shares)


def request_statistics(requests: DataFrame, *keys: str) -> DataFrame:
    """Requests, mean, longest, 95th and 99th percentile response time and share of statuses 200 to 399."""
    ok = F.col("status_code").between(200, 399)
    out = requests.groupBy(*keys).agg(
        F.count("*").alias("n"), exact_avg("response_time", 6).alias("avg_time"), F.count_if(ok).alias("succeeded"), F.max("response_time").alias("max_time")
    )
    out = out.withColumn("success_percent", percent(F.col("succeeded"), F.col("n")))
    tails = ranks.percentiles(requests, list(keys), {"p95_time": 0.95, "p99_time": 0.99}, "response_time").drop("n")
    tails = tails.withColumnsRenamed({k: f"__{k}" for k in keys})
    return out.join(tails, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True)), "left").drop(*[f"__{k}" for k in keys])


def request_report(requests: DataFrame, as_of: str, minutes: int, *keys: str) -> DataFrame:
    """request_statistics of the last minutes, with requests a minute and status_codes: how often each status came."""
    recent = requests.where(F.col("timestamp") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    by_status = recent.groupBy(*keys, "status_code").agg(F.count("*").alias("__n"))
    codes = by_status.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col("status_code").cast("string"), F.col("__n").cast("string")))), ",").alias("status_codes")
    )
    out = request_statistics(recent, *keys).withColumn("requests_per_minute", F.col("n") / F.lit(float(minutes)))
    return out.join(codes, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True)), "left").drop(*[f"__{k}" for k in keys])


def request_alerts(requests: DataFrame, slow: float = 5.0) -> DataFrame:
    """Slow or failed requests with the reason."""
    reason = F.when(F.col("status_code") >= 500, "server_error").when(F.col("response_time") > slow, "slow")
    return requests.withColumn("reason", reason).where("reason IS NOT NULL")


def log_patterns(logs: DataFrame, at_least: int = 5, most: int = 1000) -> DataFrame:
    """pattern, n, first_seen, last_seen and errors of messages' normal forms that are frequent, most frequent first."""
    found = logs.groupBy(log_pattern(F.col("message")).alias("pattern")).agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors"))
    return found.where(F.col("n") >= at_least).orderBy(F.desc("n"), "pattern").limit(most)


def pattern_samples(logs: DataFrame, patterns: DataFrame, n: int = 5) -> DataFrame:
    """The last n logs of each pattern."""
    place = F.row_number().over(W.partitionBy("pattern").orderBy(F.desc("timestamp"), F.desc("id")))
    return logs.withColumn("pattern", log_pattern(F.col("message"))).join(patterns.select("pattern"), "pattern", "left_semi").withColumn("place", place).where(F.col("place") <= n)


def pattern_context(logs: DataFrame, field: str, n: int = 5) -> DataFrame:
    """The n most frequent values of a field for each pattern."""
    counted = logs.where(F.col(field).isNotNull()).groupBy(log_pattern(F.col("message")).alias("pattern"), field).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("pattern").orderBy(F.desc("n"), field))
    return counted.withColumn("place", place).where(F.col("place") <= n)


def unpivot_metrics(df: DataFrame, ids: list[str], values: dict[str, Column]) -> DataFrame:
    """ids, metric, value: a row for each metric of a row that is a number."""
    wide = df.select(*ids, *[c.try_cast("double").alias(name) for name, c in values.items()])
    return wide.unpivot(ids, list(values), "metric", "value").where("value IS NOT NULL")


def performance_metrics(logs: DataFrame) -> DataFrame:
    """id, timestamp, metric, value from logs' details (map<string,string>)."""
    return unpivot_metrics(logs, ["id", "timestamp"], {k: F.try_element_at("details", F.lit(k)) for k in METRIC_KEYS})


def error_groups(errors: DataFrame) -> DataFrame:
    """fingerprint, occurrences, first and last seen, users: errors(error_type, message, timestamp, user_id) by what they say."""
    key = error_fingerprint(F.col("error_type"), F.col("message"), F.lit(""))
    return errors.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("occurrences"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count_distinct("user_id").alias("users"))


def suggested_actions(kind: Column, message: Column) -> Column:
    low = F.lower(F.concat_ws(" ", kind, message))
    advice = {"timeout": "raise the timeout or reduce the batch", "connection": "check the connection", "memory": "reduce memory use", "permission": "check access rights", "key": "check the input's fields", "value": "validate the input"}
    return F.filter(F.array(*[F.when(low.contains(word), F.lit(text)) for word, text in advice.items()]), lambda x: x.isNotNull())


def evaluate_rules(points: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """rules (RULES, a small table) with n, value and firing, from points(metric, value, timestamp, id) in each rule's window."""
    ago = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("timestamp").cast("timestamp"))
    near = points.withColumn("__ago", ago).where("__ago >= 0").join(rules.select("rule_id", "metric", "window_s"), "metric").where("__ago <= window_s")
    found = near.groupBy("rule_id").agg(F.count("value").alias("n"), exact_avg("value", 6).alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.max_by("value", F.struct("timestamp", "id")).alias("last"))
    out = rules.join(found, "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pick = F.when(F.col("aggregate") == "count", F.col("n").cast("double"))
    for name in ("avg", "max", "min", "last"):
        pick = pick.when(F.col("aggregate") == name, F.col(name))
    v, t = F.col("value"), F.col("threshold")
    tests = {"gt": v > t, "gte": v >= t, "lt": v < t, "lte": v <= t, "eq": F.abs(v - t) < 0.001}
    firing = reduce(lambda acc, kv: acc.when(F.col("operator") == kv[0], kv[1]), list(tests.items())[1:], F.when(F.col("operator") == "gt", tests["gt"]))
    return out.withColumn("value", pick).withColumn("firing", F.coalesce(firing, F.lit(False))).select("rule_id", "name", "level", "n", "value", "firing")


# Limits of the health ladder.
HEALTH_LIMITS = {"cpu": (80.0, 90.0), "memory": (80.0, 90.0), "disk": (85.0, 95.0)}


def system_health(points: DataFrame, as_of: str, window_s: int = 300) -> DataFrame:
    """One row: mean cpu, memory and disk of the last seconds (0 without any) and the status; a later metric's finding wins."""
    ago = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("timestamp").cast("timestamp"))
    near = points.where(ago.between(0, window_s))
    out = near.agg(*[F.coalesce(F.avg(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in HEALTH_LIMITS])
    status = F.lit("healthy")
    for m, (warning, critical) in HEALTH_LIMITS.items():
        status = F.when(F.col(m) > critical, "critical").when(F.col(m) > warning, "warning").otherwise(status)
    return out.withColumn("status", status)


def queue_status(tasks: DataFrame) -> DataFrame:
    """queue_name: pending, active, failed tasks, mean and longest wait, failures in percent."""
    out = tasks.groupBy("queue_name").agg(
        *[F.count_if(F.col("status") == s).alias(name) for s, name in (("pending", "pending"), ("running", "active"), ("failed", "failed"))],
        F.count("*").alias("total"), exact_avg("wait_s").alias("avg_wait"), F.max("wait_s").alias("max_wait"),
    )
    return out.withColumn("failed_percent", percent(F.col("failed"), F.col("total")))


def operation_summary(events: DataFrame) -> DataFrame:
    """operation: started, completed and failed events and mean duration."""
    return events.groupBy("operation").agg(*[F.count_if(F.col("phase") == p).alias(p) for p in ("started", "completed", "failed")], exact_avg("duration", 6).alias("avg_duration"))
