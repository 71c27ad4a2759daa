"""Metric collection as mergeable histograms: fixed buckets by minute, held as streaming state, added up to hours and days.

A histogram is a row: start, keys, n, total, least, most and buckets (how many values lie in each, the last one without a bound). Two
of them merge by adding, so a day's row is the same from minutes, hours or raw points, and quantiles need no raw point. Null values are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the buckets.
BOUNDS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0)
EXACT = "decimal(28,6)"


def _cells(buckets: list[Column]) -> Column:
    return F.array(*buckets).alias("buckets")


def histograms(points: DataFrame, *keys: str, size: str = "1 minute", delay: str = "10 minutes", bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Histograms of points(ts timestamp, value, keys), a stream or a table."""
    known = points.where("value IS NOT NULL AND ts IS NOT NULL")
    known = known.withWatermark("ts", delay) if points.isStreaming else known
    lows = [None, *bounds]
    inside = [(F.lit(True) if low is None else F.col("value") > low) & (F.lit(True) if high is None else F.col("value") <= high) for low, high in zip(lows, [*bounds, None])]
    out = known.groupBy(F.window("ts", size).alias("w"), *keys).agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast(EXACT).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), _cells([F.count_if(c) for c in inside])
    )
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total", "least", "most", "buckets")


def rolled(rows: DataFrame, *keys: str, size: str = "1 hour", bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Histograms of longer windows from those of shorter ones."""
    out = rows.groupBy(F.window("start", size).alias("w"), *keys).agg(
        F.sum("n").alias("n"), F.sum("total").cast(EXACT).alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), _cells([F.sum(F.get("buckets", F.lit(i))) for i in range(len(bounds) + 1)])
    )
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total", "least", "most", "buckets")


def quantile(share: float, bounds: Sequence[float] = BOUNDS) -> Column:
    """A histogram's quantile, in proportion within its bucket; the first starts at 0, the last one gives its lower bound."""
    rank = F.col("n") * F.lit(share)
    counts = F.transform("buckets", lambda b: b.cast("double"))
    running = F.transform(F.sequence(F.lit(0), F.lit(len(bounds))), lambda i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0.0), lambda a, b: a + b))
    at = F.size(F.filter(running, lambda c: c < rank))
    before = F.when(at > 0, F.get(running, at - 1)).otherwise(0.0)
    edges = F.array(F.lit(0.0), *[F.lit(float(b)) for b in bounds])
    low, high = F.get(edges, at), F.get(edges, at + 1)
    return F.when(at >= len(bounds), F.get(edges, F.lit(len(bounds)))).otherwise(low + (high - low) * F.try_divide(rank - before, F.get(counts, at)))


def levels(minutes: DataFrame, *keys: str) -> DataFrame:
    """level (minute, hour, day) and the histograms of each, from those by minute."""
    hours = rolled(minutes, *keys)
    days = rolled(hours, *keys, size="1 day")
    named = [rows.select(F.lit(level).alias("level"), "start", *keys, "n", "total", "least", "most", "buckets") for level, rows in (("minute", minutes), ("hour", hours), ("day", days))]
    return named[0].unionByName(named[1]).unionByName(named[2])
