"""Reports over tasks, schedules, alerts, duplicates and suppliers, and the lists and job records that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import percent
from . import quality
from .operations import since
from .predicates import available_products, active_suppliers
from .statistics import ERRORS, exact_avg

# A supplier's phone length and name length that count as accurate, and thresholds of a supplier report.
PHONE_LENGTH, NAME_LENGTH = (7, 15), 200
SUPPLIER_THRESHOLDS = {"completeness": 0.80, "accuracy": 0.90, "validity": 0.95, "consistency": 0.85}
#: A job's outcome by a task's status.
SUCCESS, FAILED = ("success", "completed"), ("failure", "failed", "revoked")


# Lists ----------------------------------------------------------------------------------------------------------------
def top(df: DataFrame, n: int, *order: Column, skip: int = 0) -> DataFrame:
    ordered = df.orderBy(*order)
    return (ordered.offset(skip) if skip else ordered).limit(n)


def updated_since(df: DataFrame, column: str, as_of: str, since_time: str | None = None, hours: int = 24) -> DataFrame:
    """Rows changed at or after since_time, by default in the last `hours` up to as_of; rows without a time are left out."""
    start = F.lit(since_time).cast("timestamp") if since_time is not None else F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return df.where(F.col(column).cast("timestamp") >= start)


def high_rated(products: DataFrame, least: float = 4.0, n: int = 10) -> DataFrame:
    """Active products of a rating or more, by id, the first n."""
    return top(products.where((F.col("status") == "active") & (F.col("rating") >= least)), n, F.asc("id"))


def newest_available(products: DataFrame, at: str = "updated_at", n: int = 100, skip: int = 0) -> DataFrame:
    return top(available_products(products), n, F.desc(at), F.asc("id"), skip=skip)


def busiest_suppliers(suppliers: DataFrame, n: int = 100) -> DataFrame:
    return top(active_suppliers(suppliers), n, F.desc("product_count"), F.asc("id"))


def recent_errors(logs: DataFrame, since_time: str, n: int = 20) -> DataFrame:
    return top(logs.where(F.col("level").isin(*ERRORS) & (F.col("timestamp") >= F.lit(since_time).cast("timestamp"))), n, F.desc("timestamp"), F.desc("id"))


def slow_requests(requests: DataFrame, least: float = 1.0, n: int = 10) -> DataFrame:
    return top(requests.where(F.col("response_time") >= least), n, F.desc("response_time"), F.asc("id"))


# Figures --------------------------------------------------------------------------------------------------------------
def counts_by(df: DataFrame, *fields: str) -> DataFrame:
    """field, value, n of each field, and all rows under `all`: one pass over combinations, then one over their counts."""
    cells = df.groupBy(*fields).agg(F.count("*").alias("__n"))
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    rows = cells.select("__n", F.inline(F.array(*parts, F.struct(F.lit("all").alias("field"), F.lit(None).cast("string").alias("value")))))
    return rows.groupBy("field", "value").agg(F.sum("__n").alias("n"))


def alert_statistics(alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Alerts(level, status, rule_name, triggered_at) of the last hours by level, status and rule."""
    return counts_by(alerts.where(since("triggered_at", as_of, hours * 3600)), "level", "status", "rule_name")


def task_figures(tasks: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """tasks(status, queue, priority, finished_at): counts by each field; field success_rate has the share of success among those that ended in the last hours."""
    ended = tasks.where(F.col("status").isin(*SUCCESS, *FAILED) & since("finished_at", as_of, hours * 3600))
    rate = ended.agg(F.coalesce(F.try_divide(F.count_if(F.col("status").isin(*SUCCESS)), F.count("*")), F.lit(0.0)).alias("rate"))
    counted = counts_by(tasks, "status", "queue", "priority").withColumn("rate", F.lit(None).cast("double"))
    return counted.unionByName(rate.select(F.lit("success_rate").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("n"), "rate"))


def health_trends(health: DataFrame, as_of: str, hours: int = 24, fields: tuple[str, ...] = ("error_rate", "avg_response_time")) -> DataFrame:
    """field, points, current, avg, max, min and trend of health(timestamp, id, fields) in the last hours; increasing if the last value is above the first, else decreasing."""
    order = F.struct("timestamp", "id")
    long = health.where(since("timestamp", as_of, hours * 3600)).select("timestamp", "id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])))
    out = long.groupBy("field").agg(
        F.count("*").alias("points"), F.max_by("value", order).alias("current"), exact_avg("value", 6).alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.min_by("value", order).alias("__first")
    )
    return out.withColumn("trend", F.when(F.col("current") > F.col("__first"), "increasing").otherwise("decreasing")).drop("__first")


def schedule_statistics(schedules: DataFrame) -> DataFrame:
    """schedules(enabled, running, schedule_type, queue): counts by type and queue, and enabled, disabled, running and all under `state`."""
    by = counts_by(schedules, "schedule_type", "queue").where("field <> 'all'")
    states = schedules.agg(F.count_if("enabled").alias("enabled"), F.count_if(~F.coalesce("enabled", F.lit(False))).alias("disabled"), F.count_if("running").alias("running"), F.count("*").alias("all"))
    rows = [F.struct(F.lit("state").alias("field"), F.lit(s).alias("value"), F.col(s).alias("n")) for s in ("enabled", "disabled", "running", "all")]
    return by.unionByName(states.select(F.inline(F.array(*rows))))


def batch_schedule_status(schedules: DataFrame) -> DataFrame:
    """batch_id with total, completed, failed and running schedules(batch_id, running, task_status), and whole percents of those that ended."""
    idle = ~F.coalesce(F.col("running"), F.lit(False))
    out = schedules.where("batch_id IS NOT NULL").groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(idle & F.col("task_status").isin(*SUCCESS)).alias("completed"), F.count_if(idle & F.col("task_status").isin(*FAILED)).alias("failed"), F.count_if(~idle).alias("running")
    )
    return out.withColumn("progress", F.floor((F.col("completed") + F.col("failed")) * 100 / F.col("total")).cast("int"))


def duplicate_fields(groups: DataFrame) -> DataFrame:
    """field, n: in how many groups(duplicate_fields array) the members agree on a field."""
    return groups.select(F.explode("duplicate_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def sync_roll_up(items: DataFrame, *keys: str) -> DataFrame:
    """keys, total, synced, failed, issues and progress of a sync's items(success, issues): what isn't a success has failed; progress goes from 10 to 90 with the items."""
    out = items.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.coalesce("success", F.lit(False))).alias("synced"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"))
    out = out.withColumn("failed", F.col("total") - F.col("synced"))
    return out.withColumn("success_percent", percent(F.col("synced"), F.col("total")))


# Suppliers' quality ---------------------------------------------------------------------------------------------------
def supplier_accuracy(suppliers: DataFrame) -> DataFrame:
    """Share of suppliers whose phone has 7 to 15 digits, if given, and whose name isn't too long."""
    digits = F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), r"\D", ""))
    ok = ((F.coalesce("phone", F.lit("")) == "") | digits.between(*PHONE_LENGTH)) & (F.length(F.coalesce("name", F.lit(""))) <= NAME_LENGTH)
    return suppliers.agg(F.coalesce(F.count_if(ok) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("value"))


def supplier_report(suppliers: DataFrame, pairs: DataFrame) -> DataFrame:
    """metric, value, threshold, level of suppliers and overall; pairs: one row with n, pairs of equal name or phone."""
    metrics = {
        "completeness": quality.completeness(suppliers, quality.SUPPLIER_FIELDS), "accuracy": supplier_accuracy(suppliers), "validity": quality.validity(suppliers, emails=("email",), phones=("phone",)),
        "consistency": quality.consistency(suppliers, ("name",), None, pairs), "uniqueness": quality.uniqueness(suppliers, ("source_id", "name")),
    }
    return quality.quality_report(metrics, SUPPLIER_THRESHOLDS)


# Job records and marks ------------------------------------------------------------------------------------------------
def job_record(results: DataFrame, entity: str, source: str, kind: str, started: str, completed: str) -> DataFrame:
    """One row for an import, export or sync job: what ran when, its status and its figures as JSON; results: one row."""
    figures = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(results.columns)]))
    return results.select(
        F.lit(entity).alias("entity_type"), F.lit(source).alias("source_system"), F.lit(kind).alias("sync_type"), F.lit("completed").alias("status"),
        F.lit(started).cast("timestamp").alias("started_at"), F.lit(completed).cast("timestamp").alias("completed_at"), figures.alias("result_data"),
    )


def mark_processed(rows: DataFrame, cleaned: DataFrame, key: str = "source_id", status: str = "processed") -> DataFrame:
    """rows whose keys were cleaned with success(key, status) marked, with `marked`; its count is that of the rows saved."""
    good = cleaned.where((F.col("status") == "success") & (F.coalesce(F.col(key), F.lit("")) != "")).select(key).distinct().withColumn("__good", F.lit(True))
    out = rows.join(good, key, "left").withColumn("marked", F.coalesce("__good", F.lit(False))).drop("__good")
    return out.withColumn("sync_status", F.when(F.col("marked"), status).otherwise(F.col("sync_status")))
