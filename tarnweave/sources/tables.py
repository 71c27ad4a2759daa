"""Parquet, JDBC, JSON-lines and text sources, and file sinks. Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import one_of

LOG = "timestamp string, level string, message string, context map<string,string>, details map<string,string>, error map<string,string>, duration_ms double, stack_trace string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(spark: SparkSession, query: str, **params) -> DataFrame:
    return spark.sql(query, args=params)


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, partitions: int = 50, fetch: int = 10_000) -> DataFrame:
    """A table read by ranges of a numeric key, one connection for each."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, fetchsize=fetch).load()


def json_logs(spark: SparkSession, path: str, since=None) -> DataFrame:
    """JSON-lines logs as LOG with real timestamps; lines that don't parse, or have no time, are left out."""
    rows = spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).withColumn("timestamp", F.try_to_timestamp("timestamp"))
    rows = rows.where("timestamp IS NOT NULL")
    return rows.where(F.col("timestamp") >= F.lit(since).cast("timestamp")) if since else rows


def tail(spark: SparkSession, path: str, n: int = 100, level: str | None = None) -> DataFrame:
    """The last n lines (that hold a level's name) of text files, files in name order: file, line_no, value."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    lines = lines.where(F.col("value").contains(level)) if level else lines
    return lines.orderBy(F.desc("file"), F.desc("line_no")).limit(n)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes and modified of files; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))


def storage_statistics(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("n_bytes").alias("n_bytes"))


def import_new(existing: DataFrame, incoming: DataFrame, key: str, overwrite: bool = False, order: str | None = None) -> DataFrame:
    """existing with the incoming rows of unknown keys; overwrite: incoming rows replace those of the same key. Of repeated keys the last by `order` counts, then the greatest row."""
    new = one_of(incoming, [key], order)
    if overwrite:
        return existing.join(new.select(key), key, "left_anti").unionByName(new.select(*existing.columns))
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns))


def export(df: DataFrame, path: str, kind: str = "json", rows_a_file: int = 1_000_000) -> None:
    """Write as json, csv (with a header), parquet or orc; workbooks aren't supported."""
    if kind not in ("json", "csv", "parquet", "orc"):
        raise ValueError(f"unsupported format: {kind}")
    writer = df.write.mode("errorifexists").option("maxRecordsPerFile", rows_a_file)
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def partitioned_by_month(df: DataFrame, column: str, path: str) -> None:
    """A table partitioned by month, so that time filters prune folders; rows of a month are dealt to writers by key ranges."""
    df.withColumn("month", F.date_format(column, "yyyy-MM")).write.mode("errorifexists").partitionBy("month").parquet(path)
