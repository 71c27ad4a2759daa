"""Derived properties of products, suppliers, images and syncs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_range_text(low: Column, high: Column) -> Column:
    both = low.isNotNull() & high.isNotNull()
    same = F.format_string("%.2f", low.cast("double"))
    return F.when(both & (low != high), F.concat(same, F.lit("-"), F.format_string("%.2f", high.cast("double")))).when(low.isNotNull(), same)


def is_available(status: Column, low: Column) -> Column:
    return F.coalesce((status == "active") & (low > 0), F.lit(False))


def size_mb(n_bytes: Column) -> Column:
    return F.round(F.coalesce(n_bytes, F.lit(0)) / F.lit(1024.0 * 1024.0), 2)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.round(width / height, 2)).otherwise(0.0)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def records_per_second(processed: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, (processed / seconds).cast("long")).otherwise(F.lit(0).cast("long"))


def level_of(value: Column, threshold: Column) -> Column:
    """Quality level of a share against its threshold."""
    return F.when(value >= 0.9, "excellent").when(value >= threshold, "good").when(value >= threshold - 0.1, "fair").when(value >= threshold - 0.2, "poor").otherwise("critical")


def worst(*levels: Column) -> Column:
    """critical over warning over healthy."""
    any_of = lambda x: F.array_contains(F.array(*levels), x)
    return F.when(any_of("critical") | any_of("error"), "critical").when(any_of("warning"), "warning").otherwise("healthy")
