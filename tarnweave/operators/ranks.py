"""Exact order statistics of large keys: values are counted, ranges of values located, and only the ranges that hold a rank are sorted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of values of a key; one of them, counted by value, is sorted in a task.
RANGES = 256
#: Different values of a key that one task may hold, counted.
FEW_VALUES = 100_000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys], F.lit(True))


def _beside(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__{k}" for k in keys})


def values_at(points: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]], value: str = "value") -> DataFrame:
    """keys, n and a column for each rank: the value at that place, from 0, among a key's sorted values.

    ranks maps a name to a function of the number of values n. Null values don't count and keys without values are left out; null keys are a
    key. Ranges come from an approximate sketch of fixed size, which only balances the work: counts of ranges make the result exact.
    """
    some = points.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    counted = some.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    sketch = counted.groupBy(*keys).agg(F.sum("__c").alias("n"), F.percentile_approx("__v", shares, RANGES * 4).alias("__edges"))
    edges = _beside(sketch.select(*keys, "__edges"), keys)
    placed = counted.join(edges, _same(counted, edges, keys)).select(
        *keys, "__v", "__c", F.size(F.filter("__edges", lambda e: e <= F.col("__v"))).alias("__range")
    )
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy(*keys, "__range").agg(F.sum("__c").alias("__size"))
    ranges = ranges.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    wanted = sketch.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("rank")) for k, f in ranks.items()])).alias("__w"))
    wanted = _beside(wanted, keys)
    holds = (F.col("__w.rank") >= F.col("__start")) & (F.col("__w.rank") < F.col("__start") + F.col("__size"))
    targets = ranges.join(wanted, _same(ranges, wanted, keys) & holds).select(
        *keys, "__range", "n", F.col("__w.name").alias("__name"), (F.col("__w.rank") - F.col("__start")).alias("__rank")
    )
    targets = _beside(targets, [*keys, "__range"])
    held = placed.join(targets.select(*[f"__{k}" for k in keys], "____range").distinct(), _same(placed, targets, [*keys, "__range"]), "left_semi")
    inside = W.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    sorted_ = held.withColumn("__from", F.coalesce(F.sum("__c").over(inside), F.lit(0)))
    here = (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__c"))
    found = sorted_.join(targets, _same(sorted_, targets, [*keys, "__range"]) & here)
    return found.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("__name") == k, F.col("__v"))).alias(k) for k in ranks])


def percentiles(points: DataFrame, keys: list[str], shares: dict[str, float], value: str = "value") -> DataFrame:
    """keys, n and for each name the percentile of that share, between the two nearest values in proportion.

    Where no key has more than FEW_VALUES different values, by a sketch, one aggregation counts them by value; else ranges are used.
    """
    known = points.where(F.col(value).isNotNull())
    most = known.groupBy(*keys).agg(F.approx_count_distinct(value).alias("d")).agg(F.max("d")).first()[0] or 0
    if most <= FEW_VALUES:
        at = F.percentile(value, F.array(*[F.lit(float(s)) for s in shares.values()])).alias("__at")
        return known.groupBy(*keys).agg(F.count("*").alias("n"), at).select(*keys, "n", *[F.col("__at")[i].alias(name) for i, name in enumerate(shares)])
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, share in shares.items():
        ranks[f"__{name}_low"] = lambda n, s=share: F.floor((n - 1) * F.lit(s))
        ranks[f"__{name}_high"] = lambda n, s=share: F.ceil((n - 1) * F.lit(s))
    at = values_at(points, keys, ranks, value)

    def between(name: str, share: float) -> Column:
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        place = (F.col("n") - 1) * F.lit(share)
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return at.select(*keys, "n", *[between(name, share) for name, share in shares.items()])


def nearest_ranks(points: DataFrame, keys: list[str], shares: dict[str, float], value: str = "value") -> DataFrame:
    """keys, n and value number floor(n * share), from 0, for each name."""
    return values_at(points, keys, {name: (lambda n, s=share: F.least(F.floor(n * F.lit(s)), n - 1)) for name, share in shares.items()}, value)
