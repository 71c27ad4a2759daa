"""Record versions: creation, history, differences, reverting, pruning. A version has entity_type, entity_id, seq, data (map), created_at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import changed_fields, checksum, version_id

ENTITY = ["entity_type", "entity_id"]


def with_changes(versions: DataFrame) -> DataFrame:
    """versions with previous_data, change_type (create, update), changed_fields, checksum and version_id."""
    before = F.lag("data").over(W.partitionBy(*ENTITY).orderBy("seq"))
    out = versions.withColumn("previous_data", before)
    return out.withColumns(
        {
            "change_type": F.when(F.col("previous_data").isNull(), "create").otherwise("update"),
            "changed_fields": F.when(F.col("previous_data").isNotNull(), changed_fields(F.col("previous_data"), F.col("data"))).otherwise(F.array_sort(F.map_keys("data"))),
            "checksum": checksum(F.col("data")),
            "version_id": version_id(F.col("entity_type"), F.col("entity_id"), F.col("seq")),
        }
    )


def latest(versions: DataFrame) -> DataFrame:
    """Each entity's newest version, by aggregation, so a hot entity is combined before the shuffle."""
    return versions.groupBy(*ENTITY).agg(F.max_by(F.struct(*[c for c in versions.columns if c not in ENTITY]), "seq").alias("v")).select(*ENTITY, "v.*")


def append_changed(versions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """New versions of a snapshot(entity_type, entity_id, data, created_at): entities that are new or whose data differ."""
    last = latest(versions).select(*ENTITY, F.col("data").alias("__old"), F.col("seq").alias("__seq"))
    joined = snapshot.join(last, ENTITY, "left")
    differs = F.col("__old").isNull() | (F.size(changed_fields(F.col("__old"), F.col("data"))) > 0)
    return joined.where(differs).withColumn("seq", F.coalesce(F.col("__seq") + 1, F.lit(1))).drop("__old", "__seq")


def history(versions: DataFrame, limit: int = 50) -> DataFrame:
    """Each entity's newest versions, their place counted from the oldest of these."""
    newest = W.partitionBy(*ENTITY).orderBy(F.desc("seq"))
    some = versions.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= limit)
    return some.withColumn("place", F.row_number().over(W.partitionBy(*ENTITY).orderBy("seq"))).drop("__n")


def diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """key, field, old_value, new_value, change_type of the fields that differ between two tables of (key, data map)."""
    parts = lambda df, name: df.select(key, F.explode("data").alias("field", name))
    both = parts(old, "old_value").join(parts(new, "new_value"), [key, "field"], "full_outer")
    kind = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("modified")
    return both.where("NOT old_value <=> new_value").withColumn("change_type", kind)


def revert(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """New versions that bring back targets(entity_type, entity_id, seq); those of a deleted version are refused."""
    top = versions.groupBy(*ENTITY).agg(F.max("seq").alias("__top"))
    found = versions.join(targets.select(*ENTITY, "seq"), [*ENTITY, "seq"]).where("change_type <> 'delete'").join(top, ENTITY)
    return found.withColumn("seq", F.col("__top") + 1).withColumn("change_type", F.lit("update")).drop("__top").select(*versions.columns)


def prune(versions: DataFrame, as_of: str, keep: int = 10, days: int = 90) -> DataFrame:
    """Versions that stay: the newest `keep` of each entity, and all not older than `days`."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    newest = F.row_number().over(W.partitionBy(*ENTITY).orderBy(F.desc("seq")))
    return versions.withColumn("__n", newest).where((F.col("__n") <= keep) | (F.col("created_at") >= cutoff)).drop("__n")


def version_statistics(versions: DataFrame) -> DataFrame:
    return versions.groupBy("entity_type", "change_type").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))
