"""Referential checks between tables, repairs and the integrity report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is set and in no parent row."""
    keys = parent.select(F.col(parent_key).alias("__parent"))
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("__parent"), "left_anti")


def without_main_image(products: DataFrame, images: DataFrame) -> DataFrame:
    """Active products without a live main image."""
    main = images.where("image_type = 'main' AND product_id IS NOT NULL").select(F.col("product_id").alias("id"))
    return products.where("status = 'active'").join(main, "id", "left_anti")


def count_mismatches(suppliers: DataFrame, products: DataFrame) -> DataFrame:
    """Suppliers whose stored product_count isn't the number of their products: id, product_count, actual."""
    return with_actual_counts(suppliers, products).where("NOT product_count <=> actual").select("id", "product_count", "actual")


def with_actual_counts(suppliers: DataFrame, products: DataFrame) -> DataFrame:
    actual = products.where("supplier_id IS NOT NULL").groupBy(F.col("supplier_id").alias("id")).agg(F.count("*").alias("actual"))
    return suppliers.join(actual, "id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))


def fix_counts(suppliers: DataFrame, products: DataFrame) -> DataFrame:
    """suppliers with product_count as counted."""
    return with_actual_counts(suppliers, products).withColumn("product_count", F.col("actual").cast(suppliers.schema["product_count"].dataType)).select(*suppliers.columns)


def foreign_key_violations(pairs: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(name, n) of each (name, child, key, parent, parent_key): child rows whose key no parent has."""
    return reduce(DataFrame.unionByName, [orphans(c, k, p, pk).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, c, k, p, pk in pairs])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values of more than one row, with their number; null keys don't count."""
    some = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return some.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_members(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose keys another row shares, with the group's size and the row's place in it.

    The keys are counted with map-side combination and joined back, so no group is gathered for its size.
    """
    shared = duplicate_keys(df, *keys).withColumnRenamed("n", "group_size")
    return df.join(shared, keys).withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def inconsistent_syncs(syncs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Syncs with negative or impossible counters, or running for more than hours, with the reason."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.col("start_time")
    reason = (
        F.when((F.col("processed_count") < 0) | (F.col("success_count") < 0) | (F.col("failed_count") < 0), "negative")
        .when(F.col("processed_count") > F.col("total_count"), "too_many")
        .when((F.col("status") == "running") & (age > hours * 3600), "long_running")
    )
    return syncs.withColumn("reason", reason).where("reason IS NOT NULL")


PRIORITIES = {"orphan_products": "high", "count_mismatches": "medium", "missing_main_image": "medium", "duplicate_suppliers": "high", "inconsistent_syncs": "low"}


def integrity_report(issues: dict[str, DataFrame]) -> DataFrame:
    """kind, n, priority for each kind of issue that was found."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n", F.lit(PRIORITIES.get(kind, "low")).alias("priority")) for kind, df in issues.items()]
    return reduce(DataFrame.unionByName, counted).where("n > 0")
