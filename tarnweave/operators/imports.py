"""Imports with checks, updates and counts in one pass over the incoming rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.validate import validate_products, validate_suppliers
from ..sources.shared import shared_folder

#: What may become of a row: rejected by a check, passed over for a later row of its key, left out as known, or taken in.
OUTCOMES = ("rejected", "repeated", "kept", "updated", "inserted")


@dataclass
class Imported:
    """table: what was there, with the rows taken in; rejected: rows with their findings; counts: rows by outcome and in all, as one row."""

    table: DataFrame
    rejected: DataFrame
    counts: DataFrame


def import_rows(existing: DataFrame, incoming: DataFrame, key: str, order: str, kind: str = "product", update_existing: bool = False, folder: str | None = None) -> Imported:
    """Check incoming rows, take in the new ones and, with update_existing, those of known keys; of the good rows of a key the last by `order` counts.

    All rows are written once, by outcome, and counted while they are: the counters come from that pass. Rows of one key and order go by
    their other columns. A null key is an error of its own.
    """
    spark = incoming.sparkSession
    checked = (validate_products if kind == "product" else validate_suppliers)(incoming)
    bad = F.exists("validation", lambda r: r["level"] == "error") | F.col(key).isNull()
    known = existing.select(F.col(key).alias("__known")).where("__known IS NOT NULL").distinct()
    marked = checked.withColumn("__bad", F.coalesce(bad, F.lit(False))).join(known, F.col(key) == F.col("__known"), "left")
    rest = [F.col(c).desc() for c in incoming.columns if c not in (key, order)]
    last = W.partitionBy(key, "__bad").orderBy(F.col(order).desc(), *rest)
    outcome = F.when(F.col("__bad"), "rejected").when(F.row_number().over(last) > 1, "repeated").when(F.col("__known").isNull(), "inserted").otherwise("updated" if update_existing else "kept")
    rows = marked.withColumn("outcome", outcome).drop("__bad", "__known")
    seen = Observation(f"import-{uuid.uuid4().hex}")
    counted = rows.observe(seen, F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    path = f"{folder or shared_folder(spark)}/import-{uuid.uuid4().hex}"
    counted.write.partitionBy("outcome").parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    taken = back.where(F.col("outcome").isin("inserted", "updated"))
    keys = taken.where("outcome = 'updated'").select(key)
    table = existing.join(keys, key, "left_anti").unionByName(taken.select(*existing.columns)) if update_existing else existing.unionByName(taken.select(*existing.columns))
    figures = seen.get
    counts = spark.createDataFrame([tuple(int(figures[c]) for c in ("total", *OUTCOMES))], ", ".join(f"{c} long" for c in ("total", *OUTCOMES)))
    share = F.when(F.col("total") > 0, (F.col("inserted") + F.col("updated")) / F.col("total")).otherwise(0.0)
    return Imported(table, back.where("outcome = 'rejected'").drop("outcome"), counts.withColumn("success_rate", share))
