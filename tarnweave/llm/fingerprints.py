"""Operator 10: canonical exact digest of documents, in DataFrame functions only.

The canonical form of a text is: NFKC, full case folding, NFKC again, runs of white space to one space,
trimmed. Its digest is 128 bits of xxhash64 (the second half is seeded by the first). Documents meet by
digest, and inside a digest that several rows share their canonical bytes are compared: the distinct forms
are ordered, and all but the first carry their rank in the fingerprint, so equal fingerprints mean equal
canonical bytes.

Nulls count as empty texts, a null doc_id sorts first, repeated rows share a fingerprint, empty tables give
empty results, and columns of other names pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, new_path, shuffle_partitions, table

#: Buckets of the ordered pass for each shuffle partition: enough that their sizes even out.
BUCKETS_A_PARTITION = 8
#: Bits of the bitmap of shared digests (2 MB).
BITMAP_BITS = 1 << 24


def canonical(text: Column) -> Column:
    """Null is the empty text; ICU's static methods are reached through the SQL function reflect."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.btrim(F.regexp_replace(nfkc(folded), r"[\s\x{85}\p{Z}]+", " "))


def digest(form: Column) -> Column:
    """32 hex digits of a canonical form, which should be a column of its own, computed once."""
    first = F.xxhash64(form)
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return F.concat(hexed(first), hexed(F.xxhash64(first, form)))


def collision_ranks(forms: DataFrame) -> DataFrame:
    """(digest, form, rank > 0) of canonical forms that share a digest with a smaller, different form.

    forms: digest, form. Rows meet by (digest, form) with map-side combination, so a form that a third of
    all rows share moves once from each task.
    """
    distinct = forms.groupBy("digest", "form").agg(F.lit(1).alias("one")).drop("one")
    clash = distinct.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    rank = F.row_number().over(W.partitionBy("digest").orderBy("form")) - 1
    return distinct.join(clash, "digest", "left_semi").select("digest", "form", rank.alias("rank")).where("rank > 0")


def exact_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a `fingerprint` column: equal exactly for rows whose canonical texts are byte for byte equal."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != "fingerprint"]
    forms = df.select(canonical(F.col(text)).alias("form")).select("form", digest(F.col("form")).alias("digest"))
    shared = forms.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    ranks = materialise(collision_ranks(forms.join(shared, "digest", "left_semi")), "ranks")
    full = df.select(*keep, canonical(F.col(text)).alias("__form"))
    full = full.select(*keep, "__form", digest(F.col("__form")).alias("__digest"))
    if ranks.isEmpty():
        return full.select(*keep, F.col("__digest").alias("fingerprint"))
    ranks = ranks.select(F.col("digest").alias("__digest"), F.col("form").alias("__form"), F.col("rank").alias("__rank"))
    return full.join(ranks, ["__digest", "__form"], "left").select(*keep, F.concat("__digest", F.coalesce(F.concat(F.lit("-"), "__rank"), F.lit(""))).alias("fingerprint"))


def _buckets(spark: SparkSession, ids: DataFrame) -> tuple[Column, list]:
    """Column that numbers ranges of doc_id in ascending order, about equally many rows in each; its bounds."""
    n = BUCKETS_A_PARTITION * shuffle_partitions(spark)
    found = ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted({int(x) for x in found})
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0), bounds
    ranges = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    at_or_below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
    coarse = F.size(F.filter(ranges, lambda g: g[0] <= F.col("doc_id")))
    fine = F.when(coarse > 0, (coarse - 1) * step + at_or_below(F.element_at(ranges, coarse))).otherwise(0)
    return F.coalesce(fine, F.lit(0)), bounds


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, form, digest, next_text, next_digest: the next row by (doc_id, text), the first after the last.

    Rows go once to ranges of doc_id; inside a range, a window looks one row ahead. A range's last row finds
    the next range's first row as a marked guest at its end, so no task holds more than a range and one row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket, _ = _buckets(spark, docs.select("doc_id"))
    docs = docs.withColumn("bucket", bucket)
    # one small row for each range: its smallest id, then that id's smallest text
    least = docs.groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("k")).select("bucket", F.col("k.doc_id").alias("first_id"))
    ranges = materialise(least, "ranges")  # at most BUCKETS_A_PARTITION x shuffle partitions rows of two numbers
    heads = docs.join(F.broadcast(ranges), "bucket").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("bucket").agg(F.min("text").alias("text"))
    order = W.orderBy("bucket")  # over the ranges only
    follows = ranges.select("bucket", F.lag("bucket").over(order).alias("prev"), F.max("bucket").over(W.partitionBy()).alias("last"))
    guests = heads.join(F.broadcast(follows), "bucket").select(F.lit(None).cast("long").alias("doc_id"), "text", F.coalesce("prev", "last").alias("bucket"), F.lit(True).alias("guest"))
    rows = docs.withColumn("guest", F.lit(False)).unionByName(guests)
    rows = rows.withColumn("form", canonical(F.col("text"))).withColumn("digest", digest(F.col("form")))
    after = W.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    return rows.select("doc_id", "text", "form", "digest", "guest", F.lead("text").over(after).alias("next_text"), F.lead("digest").over(after).alias("next_digest")).where("NOT guest").drop("guest")


def clashing_digests(forms: DataFrame) -> DataFrame:
    """digest of those that different canonical forms of forms(digest, form) share, byte for byte compared.

    The digests that several rows share set bits of a bitmap of fixed size, which is broadcast; only forms whose digest meets a
    set bit are sent on, and each distinct one once from a task.
    """
    place = F.pmod(F.xxhash64("digest"), F.lit(BITMAP_BITS))
    bucket, bit = F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(32_767)
    shared = forms.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    bitmaps = materialise(shared.select(bucket, bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "shared")
    octet = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    met = forms.withColumn("bucket", bucket).join(F.broadcast(bitmaps), "bucket").where(octet.bitwiseAND(F.pow(F.lit(2.0), bit % 8).cast("long")) > 0)
    return met.select("digest", "form").distinct().groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their edited texts, as op10_document_fingerprints states."""
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)))
    rows = rows.withColumn("edited_form", canonical(F.col("edited")))
    path = new_path(docs.sparkSession, "fingerprints")
    rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.col("digest").alias("fingerprint"),
        digest(F.col("edited_form")).alias("edited_fingerprint"), "edited_form", F.col("next_digest").alias("next_fingerprint"), F.xxhash64("text", "next_text").alias("both"),
    ).write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.parquet(path)
    # the documents' own forms come from another scan rather than from this table: a digest costs less than a text on disk
    own = docs.select(canonical(F.col("text")).alias("form")).select(digest(F.col("form")).alias("digest"), "form")
    forms = own.unionByName(found.select(F.col("edited_fingerprint").alias("digest"), F.col("edited_form").alias("form")))
    clash = materialise(clashing_digests(forms), "clashes")
    if not clash.isEmpty():
        ranks = materialise(collision_ranks(forms.join(clash, "digest", "left_semi")), "ranks")
        rank_of = lambda name: F.col("rank").alias(f"{name}_rank")
        again = with_next(docs).select("doc_id", F.xxhash64("text", "next_text").alias("both"), "digest", "form", "next_digest", canonical(F.col("next_text")).alias("next_form"))
        first = again.join(ranks, ["digest", "form"], "left").withColumnRenamed("rank", "fingerprint_rank").drop("digest", "form")
        after = ranks.select(F.col("digest").alias("next_digest"), F.col("form").alias("next_form"), rank_of("next_fingerprint"))
        marks = first.join(after, ["next_digest", "next_form"], "left").select("doc_id", "both", "fingerprint_rank", "next_fingerprint_rank").distinct()
        found = found.join(ranks.select(F.col("digest").alias("edited_fingerprint"), F.col("form").alias("edited_form"), rank_of("edited_fingerprint")), ["edited_fingerprint", "edited_form"], "left")
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.both") == F.col("b.both"))
        found = found.alias("a").join(marks.alias("b"), same, "left").select("a.*", "b.fingerprint_rank", "b.next_fingerprint_rank")
        for name in ("fingerprint", "edited_fingerprint", "next_fingerprint"):
            found = found.withColumn(name, F.concat(name, F.coalesce(F.concat(F.lit("-"), f"{name}_rank"), F.lit(""))))
    alike = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("fingerprint", "edited_fingerprint").alias("near_edited"), alike("fingerprint", "next_fingerprint").alias("near_next"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, as the contract of this query states.

    Likeness of two exact digests is 1 for equal canonical forms and 0 otherwise.
    """
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
