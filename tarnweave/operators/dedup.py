"""Duplicate records: blocks, pairwise similarity, groups and their master records."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache, reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import text_or_empty
from ..functions.text import comparable, group_id
from ..sources.shared import written
from . import graph

# Field weights, the fields compared as text, and thresholds.
PRODUCT_WEIGHTS = {"title": 0.4, "price_min": 0.3, "price_max": 0.2, "category_name": 0.1}
SUPPLIER_WEIGHTS = {"name": 0.4, "phone": 0.3, "company_name": 0.2, "address": 0.1}
TEXT_FIELDS = ("title", "name", "description")
PRODUCT_THRESHOLD, SUPPLIER_THRESHOLD = 0.85, 0.80


#: Pairs of texts that a worker remembers, and the letters of both beyond which it doesn't.
MEMO_PAIRS, MEMO_LETTERS = 1 << 15, 256


def ratio(a: str, b: str) -> float:
    """Matching-blocks similarity of two comparable texts; its arguments' order matters. Equal texts are at 1."""
    if a == b:
        return 1.0
    return short_ratio(a, b) if len(a) + len(b) <= MEMO_LETTERS else SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=MEMO_PAIRS)
def short_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def most_similarity(x: Column, y: Column) -> Column:
    """A bound on text_similarity from the texts' lengths: different texts of equal length have a letter that doesn't match."""
    m, n = F.length(x), F.length(y)
    return F.when(x == y, 1.0).otherwise(F.lit(2.0) * F.least(m, n, F.greatest(m, n) - 1) / (m + n))


def block_key(*fields: str) -> Column:
    return F.concat_ws("|", *[text_or_empty(F.col(f)) for f in fields])


def exact_groups(df: DataFrame, *fields: str) -> DataFrame:
    """Block keys of more than one row with their number; nulls count as ''."""
    return df.groupBy(block_key(*fields).alias("block")).agg(F.count("*").alias("n")).where("n > 1")


def records(df: DataFrame, block: Column, weights: dict[str, float], key: str = "id") -> DataFrame:
    """__id, __block and each field of weights in the form in which it is compared, null where it isn't given; rows without key or block are left out."""
    def form(field: str) -> Column:
        text = text_or_empty(F.col(field))
        return F.when((text != "") & (text != "0"), comparable(text) if field in TEXT_FIELDS else text)

    own = df.select(F.col(key).alias("__id"), block.alias("__block"), *[form(f).alias(f) for f in weights])
    return own.where("__id IS NOT NULL AND __block IS NOT NULL")


def record_similarity(a, b, weights: dict[str, float], of_texts) -> Column:
    """Weighted similarity of the fields that both records have, of texts by of_texts; a and b give a record's column, as records() makes it, by name."""
    score, weight = F.lit(0.0), F.lit(0.0)
    for field, w in weights.items():
        x, y = a(field), b(field)
        same = of_texts(x, y) if field in TEXT_FIELDS else F.when(x == y, 1.0).otherwise(0.0)
        both = x.isNotNull() & y.isNotNull()
        score, weight = score + F.when(both, same * w).otherwise(0.0), weight + F.when(both, w).otherwise(0.0)
    return F.coalesce(F.try_divide(score, weight), F.lit(0.0))


def own_similarity(weights: dict[str, float]) -> Column:
    """A record's similarity to its like: 1, or 0 without any field."""
    return record_similarity(F.col, F.col, weights, most_similarity)


def scored(rows: DataFrame, weights: dict[str, float], threshold: float, before: tuple[str, str], out: str) -> DataFrame:
    """left, right (the column `out` of two rows of a block) and similarity, of rows whose before[0] is less than the other's before[1].

    The lengths of texts bound a pair's similarity: only pairs that may reach the threshold get to Python.
    """
    a, b = rows.alias("a"), rows.alias("b").hint("merge")
    of = lambda side: lambda f: F.col(f"{side}.{f}")
    near = record_similarity(of("a"), of("b"), weights, most_similarity) >= threshold
    pairs = a.join(b, (F.col("a.__block") == F.col("b.__block")) & (F.col(f"a.{before[0]}") < F.col(f"b.{before[1]}")) & near)
    found = pairs.select(F.col(f"a.{out}").alias("left"), F.col(f"b.{out}").alias("right"), record_similarity(of("a"), of("b"), weights, text_similarity).alias("similarity"))
    return found.where(F.col("similarity") >= threshold)


def equal_columns(a: str, b: str, columns: list[str]) -> Column:
    """Rows of a and b are equal in these columns, nulls too."""
    return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def similar_pairs(df: DataFrame, block: Column, weights: dict[str, float], threshold: float, key: str = "id") -> DataFrame:
    """(left_id, right_id, similarity) of pairs in a block, the earlier key first. Blocks should be narrow: pairs grow with their squares.

    Rows equal in all that is compared are one class: classes are compared, once for each order in which they have rows, and their rows paired by keys.
    """
    rows, fields = records(df, block, weights, key), ["__block", *weights]
    classes = rows.groupBy(*fields).agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"))
    classes = written(classes.withColumn("__class", F.monotonically_increasing_id()), "classes")
    found = scored(classes, weights, threshold, ("__first", "__last"), "__class")
    members = rows.alias("r").join(classes.alias("c"), equal_columns("r", "c", fields)).select("__class", "__id")
    of = lambda side: members.select(F.col("__class").alias(side), F.col("__id").alias(f"{side}_id")).hint("merge")
    return found.join(of("left"), "left").join(of("right"), "right").where("left_id < right_id").select("left_id", "right_id", "similarity")


def greedy_groups(df: DataFrame, block: Column, weights: dict[str, float], threshold: float, key: str = "id") -> DataFrame:
    """Groups by first seed in key order inside each block: seed_id, id, similarity (to the seed; the seed's own is 1).

    Rows equal in all that is compared have the same neighbours: whoever takes the first of them takes the others, and if nobody does it takes
    them itself. So only first ones are paired, and the rest follow. Keys of several different records are paired themselves.
    """
    rows = written(records(df, block, weights, key).distinct(), "records")
    several = written(rows.groupBy("__id").count().where("count > 1").select("__id"), "several")
    fields = ["__block", *weights]
    single = rows.join(several, "__id", "left_anti")
    first = written(single.groupBy(*fields).agg(F.min("__id").alias("__id")), "first")
    links = scored(first.unionByName(rows.join(several, "__id", "left_semi")), weights, threshold, ("__id", "__id"), "__id")
    found = graph.greedy_groups(links.select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), "similarity"))
    taken = found.where("seed_id <> id")
    rest = single.withColumn("__own", own_similarity(weights)).alias("r").join(first.alias("f"), equal_columns("r", "f", fields) & (F.col("r.__id") > F.col("f.__id")))
    rest = rest.select(F.col("r.__id").alias("follower"), F.col("f.__id").alias("leader"), "__own").join(taken, F.col("leader") == F.col("id"), "left")
    rest = rest.where(F.col("seed_id").isNotNull() | (F.col("__own") >= threshold))
    rest = written(rest.select(F.coalesce("seed_id", "leader").alias("seed_id"), F.col("follower").alias("id"), F.coalesce("similarity", "__own").alias("similarity")), "followers")
    members = taken.unionByName(rest)
    return members.select("seed_id", F.col("seed_id").alias("id"), F.lit(1.0).alias("similarity")).distinct().unionByName(members)


def describe_groups(groups: DataFrame) -> DataFrame:
    """group_id, seed_id, size and mean similarity of each greedy group."""
    return groups.groupBy("seed_id").agg(group_id(F.collect_list("id")).alias("group_id"), F.count("*").alias("size"), F.avg(F.when(F.col("id") != F.col("seed_id"), F.col("similarity"))).alias("similarity"))


def filled(c: Column, kind: str = "string") -> Column:
    """1 for what counts as given: no null, empty text, zero or empty list."""
    if kind.startswith(("array", "map")):
        return F.when(F.size(c) > 0, 1.0).otherwise(0.0)
    return F.when(c.isNotNull() & (c.cast("string") != "") & ~c.cast("string").rlike(r"^-?0(\.0*)?(E\d+)?$"), 1.0).otherwise(0.0)


def completeness_score(df: DataFrame, groups: list[tuple[float, tuple[str, ...]]]) -> Column:
    """Sum over (points, fields) of the points times the share of fields that are given; absent fields count as empty."""
    kinds = dict(df.dtypes)
    total = F.lit(0.0)
    for points, fields in groups:
        share = sum((filled(F.col(f), kinds[f]) for f in fields if f in kinds), F.lit(0.0)) / len(fields)
        total = total + share * points
    return total


PRODUCT_POINTS = [(30, ("title", "description", "main_image_url")), (20, ("price_min", "price_max")), (20, ("sales_count", "review_count", "rating")), (15, ("main_image_url", "detail_images")), (15, ("specifications",))]
SUPPLIER_POINTS = [(30, ("name", "description", "company_name")), (25, ("phone", "email", "qq", "wechat")), (20, ("province", "city", "address")), (15, ("established_date", "registered_capital")), (10, ("certifications",))]


def masters(members: DataFrame, group: list[str], keep: str = "best", score: Column | None = None, order: str = "id") -> DataFrame:
    """One row of each group: of the best score (ties: first), the first, or the last."""
    by = {"best": [F.desc("__score"), F.asc(order)], "first": [F.asc(order)], "last": [F.desc(order)]}[keep]
    ranked = members.withColumn("__score", score if score is not None else F.lit(0.0)).withColumn("__rank", F.row_number().over(W.partitionBy(*group).orderBy(*by)))
    return ranked.where("__rank = 1").drop("__rank").withColumnRenamed("__score", "score")


def same_fields(members: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """For each group, the fields of which it has one value only, nulls aside."""
    marks = [F.when(F.count_distinct(f) == 1, F.lit(f)) for f in fields]
    return members.groupBy(*group).agg(F.array_compact(F.array(*marks)).alias("same_fields"))


def equal_name_or_phone(suppliers: DataFrame) -> DataFrame:
    """(left_id, right_id) of suppliers with equal names or phones: a union of equi-joins instead of an OR. All pairs: for values of few owners."""
    def on(field: str) -> DataFrame:
        rows = suppliers.select("id", F.col(field).alias("v")).where("v IS NOT NULL")
        return rows.alias("a").join(rows.alias("b"), (F.col("a.v") == F.col("b.v")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))

    return on("name").union(on("phone")).distinct()


def equal_value_links(df: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """field, value, a (a row), b (the value's first row), owners: each row of a shared value is linked to the first, so links grow with rows; null and empty values link nothing."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("a"), F.inline(F.array(*parts))).where("value <> ''").distinct()
    shared = rows.groupBy("field", "value").agg(F.min("a").alias("b"), F.count("*").alias("owners")).where("owners > 1")
    return rows.join(shared, ["field", "value"])


def equal_value_groups(df: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """key, component_id (the smallest key reachable by equal values) and size, of rows that share a value of some field with another."""
    found = graph.components(equal_value_links(df, fields, key).select("a", "b"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select(F.col("node").alias(key), F.col("component").alias("component_id"), "size")


def first_seen(df: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """Rows that are the first of each key in turn, and all with a null key; a row dropped by one key doesn't count for the next."""
    for key in keys:
        # rows without the key all stay, so they needn't meet
        apart = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*order), F.lit(10_000)))
        first = W.partitionBy(key, apart).orderBy(*order)
        df = df.withColumn("__n", F.row_number().over(first)).where(F.col("__n").eqNullSafe(1) | F.col(key).isNull()).drop("__n")
    return df
