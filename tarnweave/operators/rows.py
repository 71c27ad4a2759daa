"""Rows as they leave and enter tables: serialised, updated with protected fields, stamped, and the log rows that work leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.model import percent, records_per_second
from ..functions.text import extension_of
from .recovery import sync_progress
from .statistics import exact_avg

PROTECTED = ("id", "created_at")
MOST_BYTES = 10 * 1024 * 1024


def serialised(df: DataFrame, *without: str) -> DataFrame:
    """df without some columns, timestamps as ISO text (microseconds only where there are any)."""
    kept = [f for f in df.schema.fields if f.name not in without]

    def iso(name: str) -> Column:
        whole, part = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(name, "SSSSSS")
        return F.when(part == "000000", whole).otherwise(F.concat_ws(".", whole, part)).alias(name)

    return df.select(*[iso(f.name) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name) for f in kept])


def updated_from(rows: DataFrame, changes: DataFrame, key: str, as_of: str, protected: tuple[str, ...] = PROTECTED, order: str | None = None) -> DataFrame:
    """rows with the fields that changes has too, for keys with a change, and updated_at there; protected fields and unknown ones stay out.

    A null in changes is a value like others. Of several changes of a key the last by the column `order` counts, and of equal ones the greatest row.
    """
    fields = [c for c in changes.columns if c in rows.columns and c != key and c not in protected]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*([order] if order else []), *fields)).alias("__new"))
    out = rows.join(last, key, "left")
    there = F.col("__new").isNotNull()
    old = F.col("updated_at") if "updated_at" in rows.columns else F.lit(None).cast("timestamp")
    out = out.withColumns({f: F.when(there, F.col(f"__new.{f}")).otherwise(F.col(f)) for f in fields})
    return out.withColumn("updated_at", F.when(there, F.lit(as_of).cast("timestamp")).otherwise(old)).drop("__new")


def sync_performance(syncs: DataFrame) -> DataFrame:
    """task_id, id and figures of each sync: rates, records a second, progress and remaining time."""
    out = sync_progress(syncs)
    return out.select(
        "id", "task_id", "status", F.col("duration").alias("duration_seconds"), F.col("total_count").alias("total_records"), F.col("processed_count").alias("processed_records"),
        "success_rate", "failure_rate", records_per_second(F.col("processed_count"), F.col("duration")).alias("records_per_second"),
        percent(F.col("processed_count"), F.col("total_count")).alias("progress_percent"), "remaining_s",
    )


def log_entries(logs: DataFrame, context: tuple[str, ...], error: tuple[str, ...] = ()) -> DataFrame:
    """id and entry: a log as JSON with its context and, where it has any, its error; null fields are left out."""
    some = F.coalesce(*[F.col(c).cast("string") for c in error]).isNotNull() if error else F.lit(False)
    fields = [F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("level"), F.col("message"), F.struct(*context).alias("context")]
    if error:
        fields.append(F.when(some, F.struct(*error)).alias("error"))
    return logs.select("id", F.to_json(F.struct(*fields)).alias("entry"))


def stamped(rows: DataFrame, as_of: str, source: str) -> DataFrame:
    return rows.withColumns({"last_sync_at": F.lit(as_of).cast("timestamp"), "sync_source": F.lit(source)})


def failure_logs(failed: DataFrame, as_of: str, crawler: str) -> DataFrame:
    """A log row for each failed(item map<string,string>, reason)."""
    at = F.lit(as_of).cast("timestamp")
    details = F.map_concat("item", F.create_map(F.lit("__crawler"), F.lit(crawler)))
    return failed.select(
        F.lit(None).cast("long").alias("product_id"), F.concat_ws("_", F.lit(crawler), F.date_format(at, "yyyyMMdd_HHmmss")).alias("task_id"), F.lit("ERROR").alias("level"),
        F.concat(F.lit("save failed: "), F.coalesce("reason", F.lit(""))).alias("message"), details.alias("details"), F.lit(False).alias("success"), F.lit("DatabaseError").alias("error_type"), at.alias("timestamp"),
    )


def download_results(responses: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """responses(url, product_id, image_type, http_status, content_type, size, checksum) with status, path and error.

    Failed for the first of: a status other than 200, a type that isn't a picture's, more bytes than allowed. Null status or type fails.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    error = F.when(~F.col("http_status").eqNullSafe(F.lit(200)), F.concat(F.lit("HTTP "), F.coalesce(F.col("http_status").cast("string"), F.lit(""))))
    error = error.when(~kind.startswith("image/"), F.concat(F.lit("not a picture: "), kind)).when(F.col("size") > most_bytes, F.concat(F.lit("too large: "), F.col("size").cast("string")))
    ident = F.coalesce(F.col("product_id").cast("string"), F.lit("unknown"))
    path = F.concat_ws("/", F.substring(ident, 1, 2), ident, F.concat_ws(".", "checksum", extension_of(kind)))
    out = responses.withColumn("error", error)
    good = F.col("error").isNull()
    return out.withColumns({"status": F.when(good, "completed").otherwise("failed"), "path": F.when(good, path), "image_type": F.coalesce("image_type", F.lit("detail"))})


def batch_rollup(results: DataFrame, *keys: str) -> DataFrame:
    """Results(success, bytes_before, bytes_after) of a batch: how many, well, badly, bytes saved and mean share saved in percent."""
    saved = F.when(F.col("success"), F.col("bytes_before") - F.col("bytes_after"))
    out = results.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("success").alias("successful"), F.coalesce(F.sum(saved), F.lit(0)).cast("long").alias("bytes_saved"),
        F.coalesce(exact_avg(F.try_divide(saved * 100.0, F.col("bytes_before")), 6), F.lit(0.0)).alias("avg_saved_percent"),
    )
    return out.withColumn("failed", F.col("total") - F.col("successful")).withColumn("success_percent", percent(F.col("successful"), F.col("total")))


def pool_advice(pools: DataFrame) -> DataFrame:
    """pools(size, used, overflow) with utilisation and advice: grow above 0.8, shrink below 0.2, raise the overflow where there is any."""
    out = pools.withColumn("utilisation", F.try_divide("used", F.col("size") + F.col("overflow")))
    u = F.col("utilisation")
    advice = F.array(F.when(u > 0.8, "grow").when(u < 0.2, "shrink"), F.when(F.col("overflow") > 0, "raise_overflow"))
    return out.withColumn("advice", F.filter(advice, lambda x: x.isNotNull()))


def performance_advice(figures: DataFrame, most_memory: float = 80.0, most_cpu: float = 80.0) -> DataFrame:
    """figures(memory_percent, cpu_percent, hit_rate, avg_query_s) with advice(category, priority); nulls give none."""
    entry = lambda category, priority: F.struct(F.lit(category).alias("category"), F.lit(priority).alias("priority"))
    found = F.array(
        F.when(F.col("memory_percent") > most_memory, entry("memory", "high")), F.when(F.col("cpu_percent") > most_cpu, entry("cpu", "high")),
        F.when(F.col("hit_rate") < 0.5, entry("cache", "medium")), F.when(F.col("avg_query_s") > 1.0, entry("database", "high")),
    )
    return figures.withColumn("advice", F.filter(found, lambda x: x.isNotNull()))


def difference_summary(differences: DataFrame) -> DataFrame:
    """change_type, field, n, least old and greatest new value (100 characters): what changed how often."""
    cut = lambda c: F.substring(F.nullif(F.col(c), F.lit("")), 1, 100).alias(c)
    return differences.select("change_type", "field", cut("old_value"), cut("new_value")).groupBy("change_type", "field").agg(F.count("*").alias("n"), F.min("old_value").alias("least_old"), F.max("new_value").alias("greatest_new"))


def duplicate_statistics(groups: DataFrame) -> DataFrame:
    """One row of groups(size, similarity): groups, records, duplicates, share of duplicates and mean similarity (3 places)."""
    out = groups.agg(F.count("*").alias("total_groups"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_records"), F.coalesce(F.round(exact_avg("similarity", 6), 3), F.lit(0.0)).alias("average_similarity"))
    out = out.withColumn("duplicate_records", F.col("total_records") - F.col("total_groups"))
    return out.withColumn("duplicate_ratio", F.coalesce(F.try_divide("duplicate_records", "total_records"), F.lit(0.0)))


def missing_ids(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One row: wanted keys, those found, whether all are there."""
    there = rows.select(F.col(key)).distinct().withColumn("__there", F.lit(True))
    out = wanted.select(key).distinct().join(there, key, "left").agg(F.count("*").alias("wanted"), F.count("__there").alias("found"))
    return out.withColumn("complete", F.col("wanted") == F.col("found"))
