"""Prefix scans in two levels: rows are sorted into ranges, each range is summed up, and what the ranges before it add is brought to it.

No key and no table is held in one task: a key of any number of rows lies in several ranges, and only one row for each range (and key in
it) meets in a window. Ranges are of (key, order), which should tell rows apart; equal ones keep an order of their own, the same for a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: monotonically_increasing_id has a partition's number above these bits and the row's place in it below.
PLACE_BITS = 33


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """df sorted into ranges and written, with __range and __place (from 0 in its range)."""
    number = F.monotonically_increasing_id()
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", number)
    placed = sorted_.withColumn("__range", F.shiftright("__id", PLACE_BITS)).withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("__id")
    return written(placed, "ranges")


def numbered(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """df with each row's place, from 0, in the order; no global sort in one task."""
    placed = in_ranges(df, *order)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__place")).drop("__range", "__place", "__start")


def batches(df: DataFrame, size: int, *order: str | Column) -> DataFrame:
    """df with `batch`, from 0, each of `size` rows in the order but the last; keys of any type, with gaps and repeats."""
    return numbered(df, *order, name="__position").withColumn("batch", F.floor(F.col("__position") / size).cast("long")).drop("__position")


#: How the values of two stretches of rows become that of both; greatest and least pass over nulls.
ADDED = lambda a, b: F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
KINDS = {"sum": (F.sum, ADDED), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(df: DataFrame, key: str, order: list[str], **over: tuple[str, Column]) -> DataFrame:
    """df with running aggregates of each key from its first row to this one; over: name=(sum, max or min, a column)."""
    values = {f"__value_{name}": c for name, (_, c) in over.items()}
    placed = in_ranges(df.withColumns(values), key, *order)
    local = W.partitionBy("__range", key).orderBy("__place").rowsBetween(W.unboundedPreceding, 0)
    inside = placed.withColumns({f"__{name}": KINDS[kind][0](f"__value_{name}").over(local) for name, (kind, _) in over.items()})
    totals = placed.groupBy("__range", key).agg(*[KINDS[kind][0](f"__value_{name}").alias(f"__all_{name}") for name, (kind, _) in over.items()])
    earlier = W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range that the key lies in
    before = totals.select(F.col("__range").alias("__of_range"), F.col(key).alias("__of_key"), *[KINDS[kind][0](f"__all_{name}").over(earlier).alias(f"__before_{name}") for name, (kind, _) in over.items()])
    joined = inside.join(before, (F.col("__range") == F.col("__of_range")) & F.col(key).eqNullSafe(F.col("__of_key")))
    return joined.select(*df.columns, *[KINDS[kind][1](F.col(f"__before_{name}"), F.col(f"__{name}")).alias(name) for name, (kind, _) in over.items()])
