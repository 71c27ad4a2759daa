"""Similar texts by a self-join: an inverted index on the rarest two-letter grams of each text finds candidates, matching blocks verify them.

The similarity of two texts is 2 M / (letters of both), M being the letters in matching blocks. Above a threshold t, M exceeds half of t times the
letters, so at most `prefix_length` of a text's grams can be missing in the other: two such texts share a gram among that many and one
more of the rarest grams of each. Equal texts are one class, so copies cost a count; pairs are of classes, and members say which rows a class has.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

THRESHOLD = 0.9


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """class_id (the smallest key), text (in lower case) and n of rows with equal texts; rows without a text or key are left out."""
    own = df.select(F.col(key).alias("k"), F.lower(text).alias("text")).where("k IS NOT NULL AND text IS NOT NULL")
    return own.groupBy("text").agg(F.min("k").alias("class_id"), F.count("*").alias("n"))


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and class_id of each row with a text."""
    own = df.select(F.col(key), F.lower(text).alias("text")).where(F.col(key).isNotNull() & F.col("text").isNotNull())
    return own.join(classes(df, key, text), "text").select(key, "class_id")


def prefix_length(letters, threshold: float):
    """Grams of a text of so many letters among which any similar text has one: those that may be missing, and one."""
    c = threshold / 2
    return F.floor(letters * F.lit(2 - 3 * c + c / (1 - c) * (1 - 3 * c)) + F.lit(1e-9)).cast("int") + 1


def candidates(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """left, right: class_ids (the smaller first) of texts(class_id, text) that may be similar above the threshold (0.8 or more)."""
    if not 0.8 <= threshold < 1:
        raise ValueError("threshold must be from 0.8 to below 1")
    letters = F.length("text")
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), letters - 1), lambda i: F.substring("text", i, F.lit(2))))
    long = texts.where(letters >= 2).select("class_id", letters.alias("letters"), grams.alias("g"))
    # the second of two equal grams of a text is a token of its own
    tokens = long.select("class_id", "letters", F.explode(F.transform("g", lambda x, i: F.concat(x, (i + 1 - F.array_position("g", x)).cast("string")))).alias("token"))
    tokens = written(tokens, "grams")
    counts = tokens.groupBy("token").agg(F.count("*").alias("owners"))
    rarest = W.partitionBy("class_id").orderBy("owners", "token")  # no more rows than the text has letters
    prefix = tokens.join(counts, "token").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= prefix_length(F.col("letters"), threshold))
    prefix = written(prefix.where("owners > 1").select("class_id", "letters", "token"), "prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    short, longer = F.least("a.letters", "b.letters"), F.greatest("a.letters", "b.letters")
    near = (2 * short) > F.lit(threshold) * (short + longer)
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.class_id") < F.col("b.class_id")) & near).select(F.col("a.class_id").alias("left"), F.col("b.class_id").alias("right")).distinct()


def similar_texts(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """left_id, right_id (classes, the smaller first), left_n, right_n, similarity of left to right and of right to left, one of them above the threshold.

    The similarity isn't the same both ways: that of two rows is the earlier row's to the later's.
    """
    own = written(classes(df, key, text), "texts")

    @F.pandas_udf("struct<forward:double,backward:double>")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            match = SequenceMatcher(None, x, y)
            if match.quick_ratio() > threshold:  # counts of letters bound the similarity
                rows.append((match.ratio(), SequenceMatcher(None, y, x).ratio()))
            else:
                rows.append((0.0, 0.0))
        return pd.DataFrame(rows, columns=["forward", "backward"])

    pairs = written(candidates(own, threshold), "candidates").repartition("left", "right")
    of = lambda side: own.select(F.col("class_id").alias(side), F.col("text").alias(f"{side}_text"), F.col("n").alias(f"{side}_n"))
    both = pairs.join(of("left"), "left").join(of("right"), "right").withColumn("s", compare("left_text", "right_text"))
    found = both.where((F.col("s.forward") > threshold) | (F.col("s.backward") > threshold))
    return found.select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), "left_n", "right_n", F.col("s.forward").alias("forward"), F.col("s.backward").alias("backward"))


def similar_row_pairs(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row, n: pairs of rows (by key) above the threshold, equal texts included; rows are paired only where a pair's order decides."""
    found = written(similar_texts(df, key, text, threshold), "pairs")
    equal = classes(df, key, text).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("n"))
    both = (F.col("forward") > threshold) & (F.col("backward") > threshold)
    sure = found.where(both).agg(F.coalesce(F.sum(F.col("left_n") * F.col("right_n")), F.lit(0)).alias("n"))
    own = members(df, key, text)
    side = lambda name: own.select(F.col(key).alias(f"{name}_key"), F.col("class_id").alias(f"{name}_id"))
    ordered = found.where(~both).join(side("left"), "left_id").join(side("right"), "right_id")
    first = F.when(F.col("left_key") < F.col("right_key"), F.col("forward")).otherwise(F.col("backward"))
    rest = ordered.where(first > threshold).agg(F.count("*").alias("n"))
    return equal.unionByName(sure).unionByName(rest).agg(F.sum("n").cast("long").alias("n"))
