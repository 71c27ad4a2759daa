"""Statistics of products, suppliers, images, syncs, logs and tasks: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
ERRORS = ("ERROR", "CRITICAL")


def exact(c: Column | str, scale: int = 2) -> Column:
    """As a decimal, so that sums don't depend on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def exact_sum(c: Column | str, scale: int = 2) -> Column:
    return F.sum(exact(c, scale)).cast("double")


def exact_avg(c: Column | str, scale: int = 2) -> Column:
    return exact_sum(c, scale) / F.count(exact(c, scale))


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def dense_counts(df: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """A row for each value, zeros kept; other values are left out."""
    spine = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return spine.join(distribution(df.where(F.col(key).isin(*values)), key), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def top(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), F.asc(tie)).limit(n)


def supplier_product_summary(products: DataFrame) -> DataFrame:
    """For each supplier: products, lowest, highest and mean price, sales and mean rating."""
    return products.groupBy("supplier_id").agg(
        F.count("*").alias("product_count"), F.min("price_min").alias("min_price"), F.max("price_max").alias("max_price"), exact_avg("price_min").alias("avg_price"),
        F.coalesce(F.sum("sales_count"), F.lit(0)).cast("long").alias("total_sales"), exact_avg("rating").alias("avg_rating"),
    )


def price_statistics(products: DataFrame, *keys: str) -> DataFrame:
    """Count, lowest, highest and mean price, of priced products."""
    return products.where("price_min IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.min("price_min").alias("min_price"), F.max("price_max").alias("max_price"), exact_avg("price_min").alias("avg_price"))


def product_overview(products: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """One row: products by status and sync status, and those updated in the last hours."""
    recent = F.col("updated_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS") if "updated_at" in products.columns else F.lit(False)
    return products.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") != "active").alias("inactive"),
        F.count_if(F.col("sync_status") == "pending").alias("pending"), F.count_if(F.col("sync_status") == "failed").alias("failed"), F.count_if(recent).alias("recent"),
    )


def supplier_statistics(suppliers: DataFrame, *keys: str) -> DataFrame:
    """Suppliers, verified ones and their share in percent, by keys."""
    return suppliers.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("is_verified") == "Y").alias("verified")).withColumn("verified_percent", F.col("verified") * 100.0 / F.col("total"))


def image_statistics(images: DataFrame, *keys: str) -> DataFrame:
    return images.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_if(F.col("image_type") == "main").alias("main_images"), F.count_if(F.col("download_status") == "completed").alias("downloaded"), F.count_if(F.col("download_status") == "failed").alias("failed"))


def sync_statistics(syncs: DataFrame, *keys: str) -> DataFrame:
    """Syncs by outcome, durations, processed records and the share of successes in percent."""
    out = syncs.groupBy(*keys).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running")],
        F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), exact_avg("duration").alias("avg_duration"),
        F.coalesce(F.sum("processed_count"), F.lit(0)).cast("long").alias("processed"), F.coalesce(F.sum("success_count"), F.lit(0)).cast("long").alias("succeeded"),
    )
    return out.withColumn("success_rate", F.coalesce(F.try_divide(F.col("succeeded") * 100.0, "processed"), F.lit(0.0)))


def daily_summary(syncs: DataFrame, as_of: str, days: int = 7, rolling: bool = True) -> DataFrame:
    """A row for each of the last days, empty ones too: days_ago, total, completed, failed, processed.

    rolling: 24-hour spans back from as_of, else calendar days (UTC) up to that of as_of.
    """
    at = F.lit(as_of).cast("timestamp")
    if rolling:
        ago = F.floor((F.unix_timestamp(at) - F.col("start_time")) / 86400)
    else:
        ago = F.datediff(at, F.timestamp_seconds("start_time"))
    some = syncs.withColumn("days_ago", ago.cast("long")).where(F.col("days_ago").between(0, days - 1))
    found = some.groupBy("days_ago").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("processed_count").cast("long").alias("processed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return syncs.sparkSession.range(days).withColumnRenamed("id", "days_ago").join(F.broadcast(found), "days_ago", "left").select("days_ago", *map(zero, ("total", "completed", "failed", "processed")))


def log_statistics(logs: DataFrame, as_of: str) -> DataFrame:
    """One row: logs, a count for each level, errors in percent, mean duration and errors of the last 24 hours."""
    day = F.col("timestamp") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    bad = F.col("level").isin(*ERRORS)
    out = logs.agg(F.count("*").alias("total"), *[F.count_if(F.col("level") == x).alias(x.lower()) for x in LEVELS], exact_avg("duration", 6).alias("avg_duration"), F.count_if(bad & day).alias("recent_errors"))
    return out.withColumn("error_percent", F.coalesce(F.try_divide((F.col("error") + F.col("critical")) * 100.0, "total"), F.lit(0.0)))


def error_summary(logs: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n values of key with most errors."""
    return top(distribution(logs.where(F.col("level").isin(*ERRORS) & F.col(key).isNotNull()), key), "n", n, key)


def time_buckets(logs: DataFrame, unit: str) -> DataFrame:
    """Logs and errors by hour, day, week or month."""
    bucket = F.date_format(F.date_trunc(unit, F.col("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("bucket")
    return logs.groupBy(bucket).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors"))


def task_statistics(tasks: DataFrame) -> DataFrame:
    """By type: tasks, outcomes, mean duration of finished ones, success in percent of finished ones."""
    finished = F.col("status").isin("completed", "failed")
    out = tasks.groupBy("task_type").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), exact_avg(F.when(finished, F.col("duration"))).alias("avg_duration"))
    return out.withColumn("success_percent", F.coalesce(F.try_divide(F.col("completed") * 100.0, F.col("completed") + F.col("failed")), F.lit(0.0)))


def progress_summary(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"), (F.sum(F.coalesce(exact("percent"), exact(F.lit(0)))).cast("double") / F.count("*")).alias("avg_percent"))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
