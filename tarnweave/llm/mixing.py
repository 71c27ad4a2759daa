"""Operator 9: mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a target share of the mixed corpus, measured in characters. A source's rate is the mean
number of times that one of its documents must appear to reach it; a document's count is the inverse of the
Poisson distribution with that mean at a uniform number hashed from the seed and the document. Documents are
exploded by their counts and dealt out by a hash, so the whole corpus is in random order.

Null sources form one source, a null or empty text counts as one character, rows of one key draw the same
count (repeated rows among them), a row without a key draws by its text, an empty table gives an empty result. Rows of equal order keys are
dealt out by their texts too, so that no key fills a partition. Columns of the input pass through,
but for `copy_no` and `shuffle_key`, which the operator sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table

#: A rate above this is drawn as a sum of draws of at most this mean, so exp(-mean) stays a normal number.
LARGEST_PIECE = 32.0
#: Values of the distribution function that are kept for a piece: at a mean of 32, all else is below 1e-21.
CDF_LENGTH = 110
#: Sources whose rates (about a kilobyte each) are broadcast; of more, the join is salted.
BROADCAST_SOURCES = 20_000


def drawn_by(key: str) -> Column:
    """What a row is drawn by: its key, or without one its text."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))


def uniform(seed: int, key: Column, piece: Column) -> Column:
    """Uniform in [0, 1) from 52 bits of md5("seed:key:piece")."""
    text = F.concat_ws(":", F.lit(str(seed)), key, piece.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, exponent: float, repeat: float) -> DataFrame:
    """__source, rate for each source. weights: target shares by name (others get none); None: shares go as (characters of the source) ** exponent."""
    sizes = docs.groupBy(F.col("source").alias("__source")).agg(F.sum(F.greatest(F.length("text"), F.lit(1))).cast("double").alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("chars", F.lit(exponent)))
    else:
        given = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "name string, weight double")
        sizes = sizes.join(F.broadcast(given), F.col("__source") == F.col("name"), "left").select("__source", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(total)).select("__source", (F.lit(repeat) * share * F.col("all_chars") / F.col("chars")).alias("rate"))


def poisson_count(rate: Column, cdf: Column, pieces: Column, seed: int, key: Column) -> Column:
    """Sum over the pieces of how many values of the distribution function the piece's uniform number reaches."""
    draw = lambda j: F.size(F.filter(cdf, lambda x: uniform(seed, key, j) >= x))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0), lambda acc, j: acc + draw(j))).otherwise(0)


def _with_rates(docs: DataFrame, rates: DataFrame, key: str, most: int = BROADCAST_SOURCES) -> DataFrame:
    """docs with their source's rates: by broadcast where there are few sources, or else by a join in which each source is spread over all partitions."""
    if rates.count() <= most:
        return docs.join(F.broadcast(rates), docs["source"].eqNullSafe(rates["__source"]))
    salts = shuffle_partitions(docs.sparkSession)
    spread = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = docs.withColumn("__at", F.pmod(F.xxhash64(key, "text"), F.lit(salts)).cast("int"))
    return salted.join(spread, salted["source"].eqNullSafe(spread["__source"]) & (salted["__at"] == spread["__salt"])).drop("__at", "__salt")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, repeat: float = 1.0, seed: int = 9, key: str = "doc_id") -> DataFrame:
    """docs, each as often as drawn, with copy_no (from 0) and shuffle_key; repeat: size of the result against the input, in characters."""
    kept = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    own = docs.select(F.col("source"), F.coalesce("text", F.lit("")).alias("text"))
    rates = source_rates(own, weights, exponent, repeat)
    pieces = F.greatest(F.ceil(F.col("rate") / LARGEST_PIECE), F.lit(1)).cast("int")
    # p(k) = p(k-1) * mean / k and its running sum, once for each source
    step = lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), (a["cdf"] + a["p"] * F.col("mean") / k).alias("cdf"), F.concat(a["all"], F.array(a["cdf"] + a["p"] * F.col("mean") / k)).alias("all"))
    start = F.exp(-F.col("mean"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(CDF_LENGTH)), F.struct(start.alias("p"), start.alias("cdf"), F.array(start).alias("all")), step, lambda a: a["all"])
    rates = rates.withColumn("pieces", pieces).withColumn("mean", F.col("rate") / F.col("pieces")).select("__source", F.col("rate").alias("__rate"), F.col("pieces").alias("__pieces"), cdf.alias("__cdf"))
    count = poisson_count(F.col("__rate"), F.col("__cdf"), F.col("__pieces"), seed, drawn_by(key))
    rates = materialise(rates, "rates")
    drawn = _with_rates(docs, rates, key).withColumn("__count", count)
    copies = drawn.where("__count > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}"), drawn_by(key), F.lit("order"), F.col("copy_no").cast("string")))
    copies = copies.select(*[F.col(f"`{c}`") for c in kept], "copy_no", order.alias("shuffle_key"))
    return copies.repartition("shuffle_key", F.xxhash64("text")).sortWithinPartitions("shuffle_key")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of all documents: shares by the square root of each source's characters, as many characters as before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix_sources(docs)


ORACLE = f"""
WITH RECURSIVE own AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1))::DOUBLE AS chars FROM documents GROUP BY source),
tot AS (SELECT sum(chars) AS all_chars, sum(pow(chars, 0.5)) AS all_weight FROM own),
rates AS (SELECT source, pow(chars, 0.5) / all_weight * all_chars / chars AS rate FROM own, tot),
parts AS (SELECT source, rate, greatest(ceil(rate / {LARGEST_PIECE}), 1)::INT AS pieces, rate / greatest(ceil(rate / {LARGEST_PIECE}), 1) AS mean FROM rates),
dist AS (SELECT source, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf, mean FROM parts
  UNION ALL SELECT source, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1), mean FROM dist WHERE k < {CDF_LENGTH}),
lists AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM dist GROUP BY source),
drawn AS (SELECT d.*, list_sum(list_transform(range(1, p.pieces + 1), lambda j: len(list_filter(l.cdf, lambda x:
    (('0x' || substr(md5('9:' || d.doc_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) >= x)))) AS n
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, text, lang, source, n_chars, c::INT AS copy_no, md5('9:' || doc_id || ':order:' || c) AS shuffle_key
FROM (SELECT *, unnest(range(n::BIGINT)) AS c FROM drawn)
"""
