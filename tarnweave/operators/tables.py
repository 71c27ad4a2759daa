"""Changes of tables as new snapshots: upserts, updates, deletes, retention and state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import batches


def one_of(updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One update of each key: the last by `order`, and of equal ones (or without an order) the largest in its other columns, in their order."""
    rest = [c for c in updates.columns if c not in keys]
    by = F.struct(*([order] if order else []), *[c for c in rest if c != order])
    return updates.groupBy(*keys).agg(F.max(F.struct(by.alias("__by"), F.struct(*rest).alias("__row")))["__row"].alias("__row")).select(*keys, "__row.*")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """base with its rows replaced by updates of the same keys, and the other updates added."""
    new = one_of(updates, keys, order)
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*base.columns))


def insert_missing(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base and those rows whose keys it lacks (existing rows win)."""
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def coalescing_upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """base overlaid by updates, of which only non-empty fields overwrite; of repeated keys one update counts (one_of)."""
    kinds, updates = dict(base.dtypes), one_of(updates, [key])
    given = lambda c: F.nullif(F.col(f"u.{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"u.{c}")
    joined = base.alias("b").join(updates.alias("u"), F.col(f"b.{key}") == F.col(f"u.{key}"), "full_outer")
    return joined.select(*[F.coalesce(given(c) if c in updates.columns else F.lit(None), F.col(f"b.{c}")).alias(c) for c in base.columns])


def update_where(df: DataFrame, where: Column, values: dict[str, object]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({c: F.when(hit, as_column(v)).otherwise(F.col(c)) for c, v in values.items()})


def update_by_key(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """base with the non-null fields of updates(key, ...) of the same key; of repeated keys one update counts (one_of)."""
    changed = [c for c in updates.columns if c != key and c in base.columns]
    new = one_of(updates.select(key, *changed), [key]).select(key, *[F.col(c).alias(f"__{c}") for c in changed])
    return base.join(new, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


def soft_delete(df: DataFrame, where: Column, at: str) -> DataFrame:
    return update_where(df, where, {"is_deleted": "Y", "deleted_at": F.lit(at).cast("timestamp")})


def restore(df: DataFrame, where: Column) -> DataFrame:
    return update_where(df, where, {"is_deleted": "N", "deleted_at": F.lit(None).cast("timestamp")})


def delete_keys(df: DataFrame, keys: DataFrame, key: str, confirm: bool = False) -> DataFrame:
    if not confirm:
        raise ValueError("deleting needs confirm=True")
    return df.join(keys.select(key), key, "left_anti")


def retain(df: DataFrame, column: str, as_of: str, days: int, unless: Column | None = None) -> DataFrame:
    """Rows not older than days, and those that `unless` holds for."""
    keep = F.col(column) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(keep | unless if unless is not None else keep)


def set_image_status(images: DataFrame, results: DataFrame) -> DataFrame:
    """images with download_status of results(id, download_status); a failure adds 1 to retry_count."""
    new = results.groupBy("id").agg(F.max("download_status").alias("__new"))  # of several results, a failure counts
    out = images.join(new, "id", "left").withColumn("retry_count", F.col("retry_count") + F.when(F.col("__new") == "failed", 1).otherwise(0))
    return out.withColumn("download_status", F.coalesce("__new", "download_status")).select(*images.columns)


def retry_failed(images: DataFrame, most: int = 3, limit: int = 100) -> DataFrame:
    """The failed images under the retry limit that go back to pending, fewest retries first."""
    return images.where((F.col("download_status") == "failed") & (F.col("retry_count") < most)).orderBy("retry_count", "id").limit(limit).withColumn("download_status", F.lit("pending"))


# Which states may follow a task's state.
TRANSITIONS = {"pending": ("running", "cancelled"), "running": ("completed", "failed", "cancelled"), "failed": ("pending",), "completed": (), "cancelled": ()}


def transition(tasks: DataFrame, wanted: DataFrame, key: str = "task_id") -> DataFrame:
    """tasks in the state that wanted(key, status) asks for where it may follow theirs, with `accepted`; of several requests for a task the largest counts."""
    new = wanted.groupBy(key).agg(F.max("status").alias("__new"))
    allowed = F.lit(False)
    for old, following in TRANSITIONS.items():
        if following:
            allowed = allowed | ((F.col("status") == old) & F.col("__new").isin(*following))
    joined = tasks.join(new, key, "left").withColumn("accepted", F.col("__new").isNotNull() & allowed)
    return joined.withColumn("status", F.when(F.col("accepted"), F.col("__new")).otherwise(F.col("status"))).drop("__new")


def latest_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's last event, combined before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("e")).select(key, "e.*")


def batch_numbers(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with `batch`, of `size` rows each in order of a key of any type, gaps and repeats included; rows of equal keys are in an order of their own."""
    return batches(df, size, key)


def batch_tasks(df: DataFrame, key: str, size: int) -> DataFrame:
    """batch, total_batches, items, first and last key of the tasks that batches of rows become."""
    numbered = batch_numbers(df.select(key), key, size).groupBy("batch").agg(F.count("*").alias("items"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    total = df.agg(F.ceil(F.count("*") / size).cast("long").alias("total_batches"))  # one row
    return numbered.join(F.broadcast(total))


def resumable(tasks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Failed or revoked tasks that have a checkpoint."""
    return tasks.where(F.col("status").isin("failed", "revoked")).join(checkpoints.select("task_id"), "task_id", "left_semi")


def newest(df: DataFrame, keys: list[str], order: str, n: int, tie: str) -> DataFrame:
    """The n newest rows of each key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie)))
    return df.withColumn("place", place).where(F.col("place") <= n)
