"""The corpus pipeline: five of the operators, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() applies them to the documents of sf_dir, each stage written and read again in between.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnweave.llm.common import byte_bpe_path, materialise, only_rows, table
from tarnweave.llm.language_id import identify_documents, learn
from tarnweave.llm.mixing import mix_sources
from tarnweave.llm.near_copies import near_copy_classes
from tarnweave.llm.packing import pack_documents
from tarnweave.llm.toxicity import THRESHOLD, fit_on, with_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Files whose names are broadcast to number their rows.
MOST_FILES = 100_000
#: Spark's bound on the bytes of a batch of rows on its way to a Python worker; by itself it counts rows only, 10 000, however long.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def _bound_batches(spark: SparkSession) -> None:
    """Batches of documents are bounded by bytes for the rest of the session, unless it has a bound of its own. No row is left out."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of the numbered docs whose row number is in kept(row_no)."""
    return only_rows(docs, materialise(kept, "kept")).select(*COLUMNS)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of its own for each row, the same however and how often it is read.

    The rows of Parquet files are numbered by file and place in it. Other plans, and tables of more than MOST_FILES files, are written
    once with a running number, which follows the partitions of that run.
    """
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        placed = None
    if placed is not None:
        files = materialise(placed.select("__file").distinct(), f"{name}-files")
        if files.count() <= MOST_FILES:
            numbers = files.withColumn("__no", F.row_number().over(Window.orderBy("__file")).cast("long"))
            return placed.join(F.broadcast(numbers), "__file").select(*COLUMNS, (F.shiftleft("__no", 40) + F.col("__at")).alias("row_no"))
    return materialise(_documents(docs).withColumn("row_no", F.monotonically_increasing_id()), f"{name}-rows")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; those without a clear language go."""
    _bound_batches(spark)
    rows = _numbered(docs, "language_id")
    # written first: a filter would be pushed below the fusion and repeat its expressions
    found = materialise(identify_documents(rows, learn(docs), ["row_no"]), "languages")
    return _only(rows, found.where("accepted").select("row_no"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold."""
    _bound_batches(spark)
    model = fit_on(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return with_toxicity(_documents(docs), model, keep=COLUMNS).where(F.col("score") < THRESHOLD).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the first row with the smallest doc_id."""
    _bound_batches(spark)
    rows = _numbered(docs, "simhash_dedup")
    classes = near_copy_classes(rows, keep=("doc_id",))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_no"))
    return _only(rows, classes.groupBy("component_id").agg(F.min(order).alias("first")).select("first.row_no"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts so that sources take shares by the square root of their characters."""
    return mix_sources(_documents(docs)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents: doc_id, piece, start, length, ids_crc32, ids (little-endian uint32), sequence_id, offset."""
    _bound_batches(spark)
    return pack_documents(docs, byte_bpe_path())


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("simhash_dedup", simhash_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Models and packing are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
