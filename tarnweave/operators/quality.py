"""Data quality: completeness, accuracy, validity, consistency and uniqueness, each from one aggregation, and their score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import is_url
from ..functions.model import level_of
from ..functions.validate import valid_email, valid_phone

# Field classes, bounds, thresholds and the weights of the overall score.
PRODUCT_FIELDS = {"required": ("source_id", "title"), "important": ("description", "price_min", "main_image_url"), "optional": ("subtitle", "video_url", "specifications")}
SUPPLIER_FIELDS = {"required": ("source_id", "name"), "important": ("phone", "company_name", "address"), "optional": ("email", "qq", "wechat", "description")}
FIELD_WEIGHTS = {"required": 0.5, "important": 0.3, "optional": 0.2}
THRESHOLDS = {"completeness": 0.85, "accuracy": 0.90, "validity": 0.95, "consistency": 0.80, "uniqueness": 0.95}
SCORE_WEIGHTS = {"completeness": 0.30, "accuracy": 0.25, "validity": 0.20, "consistency": 0.15, "uniqueness": 0.10}
LOWEST_PRICE, HIGHEST_PRICE, HIGHEST_RATING, HIGHEST_SALES = 0.01, 1_000_000, 5.0, 10_000_000


def filled(df: DataFrame, name: str) -> Column:
    """1.0 where a field is given: blank text and empty lists aren't, zero is; 0.0 for a field that df lacks."""
    kinds = dict(df.dtypes)
    if name not in kinds:
        return F.lit(0.0)
    c = F.col(name)
    ok = c.isNotNull() & (F.trim(c) != "" if kinds[name] == "string" else F.size(c) > 0 if kinds[name].startswith(("array", "map")) else F.lit(True))
    return F.when(ok, 1.0).otherwise(0.0)


def share(ok: Column) -> Column:
    """Share of rows for which ok holds; rows where it is null don't."""
    return F.count_if(F.coalesce(ok, F.lit(False))) / F.count("*")


def completeness(df: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    total = F.lit(0.0)
    for kind, names in fields.items():
        total = total + FIELD_WEIGHTS[kind] * reduce(lambda a, b: a + b, [F.sum(filled(df, n)) / F.count("*") for n in names]) / len(names)
    return df.agg(total.alias("value"))


def accuracy(products: DataFrame) -> DataFrame:
    within = lambda c, low, high: F.col(c).isNull() | F.col(c).between(low, high)
    kept = within("price_min", LOWEST_PRICE, HIGHEST_PRICE) & within("price_max", LOWEST_PRICE, HIGHEST_PRICE) & within("rating", 0.0, HIGHEST_RATING)
    kept = kept & ~F.coalesce((F.col("price_min") != 0) & (F.col("price_max") != 0) & (F.col("price_min") > F.col("price_max")), F.lit(False))
    return products.agg(share(kept & (F.col("sales_count").isNull() | (F.col("sales_count") <= HIGHEST_SALES))).alias("value"))


def validity(df: DataFrame, urls: tuple[str, ...] = (), emails: tuple[str, ...] = (), phones: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows whose given URLs, e-mails and phones are all well formed."""
    ok = F.lit(True)
    for names, valid in ((urls, is_url), (emails, valid_email), (phones, valid_phone)):
        for n in names:
            ok = ok & (F.col(n).isNull() | (F.col(n) == "") | valid(F.col(n)))
    return df.agg(share(ok).alias("value"))


def consistency(df: DataFrame, texts: tuple[str, ...], currency: str | None, pairs: DataFrame) -> DataFrame:
    """Clamped .3 x (1 - currencies / rows) + .2 x (1 - min(sd / mean of a text's length, 1)) for each text - .3 x pairs / rows; pairs: one row with n."""
    n = F.count("*")
    value = F.lit(0.0)
    if currency:
        value = value + 0.3 * (1 - F.count_distinct(F.coalesce(F.col(currency), F.lit("CNY"))) / n)
    for t in texts:
        size = F.length(F.coalesce(F.col(t), F.lit("None"))).cast("double")
        value = value + 0.2 * (1 - F.least(F.coalesce(F.try_divide(F.stddev_samp(size), F.avg(size)), F.lit(0.0)), F.lit(1.0)))
    counted = df.agg(value.alias("v"), n.alias("rows")).crossJoin(pairs.select(F.col("n").alias("pairs")))  # one row each
    return counted.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") - 0.3 * F.coalesce(F.try_divide("pairs", "rows"), F.lit(0.0)))).alias("value"))


def equal_text_pairs(df: DataFrame, field: str) -> DataFrame:
    """One row, n: pairs of rows with equal texts, from group sizes, so no pair is formed."""
    sizes = df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("c"))
    return sizes.agg(F.coalesce(F.sum(F.expr("c * (c - 1) div 2")), F.lit(0)).cast("long").alias("n"))


def uniqueness(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean over keys of (distinct values - surplus rows) / rows; may be negative."""
    one = lambda k: (2 * F.count_distinct(k) - F.count(k)) / F.count("*")
    return df.agg((reduce(lambda a, b: a + b, map(one, keys)) / len(keys)).alias("value"))


def quality_report(metrics: dict[str, DataFrame], thresholds: dict[str, float] | None = None) -> DataFrame:
    """metric, value, threshold, level of each metric, and the weighted `overall` one; metrics' frames have one row with value."""
    limits = THRESHOLDS | (thresholds or {})
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(limits[name]).alias("threshold"), F.lit(SCORE_WEIGHTS[name]).alias("w")) for name, df in metrics.items()])
    overall = rows.agg(F.sum(F.col("value") * F.col("w")).alias("v"), F.sum("w").alias("w")).select(F.lit("overall").alias("metric"), (F.col("v") / F.col("w")).alias("value"), F.lit(0.80).alias("threshold"))
    out = rows.drop("w").unionByName(overall)
    return out.withColumn("level", level_of(F.col("value"), F.col("threshold")))


ADVICE = {"completeness": "fill the missing fields", "accuracy": "correct values out of range", "validity": "correct malformed addresses", "consistency": "align units and remove near duplicates", "uniqueness": "merge duplicate keys", "overall": "start with the lowest metric"}


def recommendations(report: DataFrame) -> DataFrame:
    """metric, level, advice of the metrics below their thresholds, worst first."""
    texts = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    gap = F.col("threshold") - F.col("value")
    return report.where(gap > 0).select("metric", "level", F.try_element_at(texts, F.col("metric")).alias("advice"), F.row_number().over(W.orderBy(F.desc(gap), "metric")).alias("place"))
