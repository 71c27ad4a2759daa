"""Streams of events: windowed counts, sliding means, sessions, first-seen filters and running error groups.

Rules: event time is `ts`; rows later than DELAY behind the newest are dropped; state ends with the watermark.
A stream's own name for a window is its start.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELAY = "10 minutes"


def event_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """events.parquet of a folder (a file or a folder itself, so named by a pattern) as a stream, its time as a timestamp that a watermark accepts."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{folder}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, size: str = "1 hour") -> DataFrame:
    watermarked = events.withWatermark("ts", DELAY) if events.isStreaming else events
    return watermarked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding_means(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    watermarked = events.withWatermark("ts", DELAY) if events.isStreaming else events
    mean = F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count("value")
    return watermarked.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"), mean.alias("avg_value")).select(F.col("w.start").alias("start"), "event_type", "n", "avg_value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    watermarked = events.withWatermark("ts", DELAY) if events.isStreaming else events
    return watermarked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, *keys: str) -> DataFrame:
    if events.isStreaming:
        return events.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def error_state(events: DataFrame) -> DataFrame:
    """Errors by user so far (update mode): one row of state for each user with errors."""
    return events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))


def alerts(events: DataFrame, threshold: float) -> DataFrame:
    """Stateless filter for foreachBatch sinks."""
    return events.where((F.col("event_type") == "error") | (F.col("value") > threshold))


def run_to_end(stream: DataFrame, mode: str, path: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is now and read its result from Parquet in path.

    append: rows as they become final; update: each batch adds the rows that it changed, and the last of each of `keys`
    is read, so state ends with the watermark and nothing but files leaves the executors; complete: the last batch.
    """
    spark = stream.sparkSession
    name = f"tarnweave_{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/{name}-state")
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/{name}").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/{name}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{name}/batch={0 if mode == 'complete' else number}")  # a repeated batch replaces itself

    writer.foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/{name}")
    if mode == "complete":
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")
