"""Task progress, checkpoints, recovery and resumption as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.model import percent

# Of each task type most retries, first delay in seconds, its factor, strategy and use of checkpoints; status names.
RECOVERY = {
    "crawler": (5, 30, 1.5, "resume", True),
    "image_processing": (3, 60, 2.0, "restart", False),
    "data_sync": (10, 120, 2.0, "resume", True),
    "batch_processing": (3, 300, 2.0, "restart", True),
}
STATUSES = {"PENDING": "pending", "STARTED": "started", "SUCCESS": "success", "FAILURE": "failure", "RETRY": "retry", "REVOKED": "revoked", "PROGRESS": "progress"}
DONE = ("success", "failure")
#: Fixed value: an hour.
LONGEST_DELAY_S = 3600.0


def task_status(name: Column) -> Column:
    """A worker's status name as a task's status; unknown ones and null are pending."""
    known = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(name, F.lit(""))), F.lit("pending"))


def task_type(name: Column) -> Column:
    """The task type that a task's name holds, the first in the table's order, or default."""
    out = F
    for kind in RECOVERY:
        out = out.when(name.contains(kind), kind)
    return out.otherwise("default")


def sync_progress(syncs: DataFrame) -> DataFrame:
    """syncs with success_rate and failure_rate (percent of processed, 2 places) and remaining_s, 0 unless running with progress."""
    done, spent = F.col("processed_count"), F.coalesce(F.col("duration"), F.lit(0)).cast("double")
    rate = lambda part: F.coalesce(F.round(F.try_divide(F.col(part) * F.lit(100.0), done), 2), F.lit(0.0))
    left = ((F.col("total_count") - done) * (spent / done)).cast("long")
    remaining = F.when((F.col("status") == "running") & (done > 0) & (spent > 0), left).otherwise(F.lit(0).cast("long"))
    return syncs.withColumns({"success_rate": rate("success_count"), "failure_rate": rate("failed_count"), "remaining_s": remaining})


def shown_progress(syncs: DataFrame) -> DataFrame:
    """id, minutes (whole), rate (whole percent): what a task table shows."""
    rate = F.coalesce(F.round(F.try_divide(F.col("success_count") * F.lit(100.0), "processed_count")), F.lit(0.0))
    return syncs.select("id", F.floor(F.coalesce("duration", F.lit(0)) / 60).alias("minutes"), rate.alias("rate"))


def checkpoint_checksum() -> Column:
    """MD5 of the checkpoint's JSON with its keys in order; null fields are left out."""
    return F.md5(F.to_json(F.struct("progress_data", "state_data", "task_id", "task_name", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))))


def with_checkpoint_ids(points: DataFrame, keep: int = 10) -> DataFrame:
    """Checkpoints of points(task_id, task_name, timestamp, progress_data, state_data): the newest `keep` of each task, with id and checksum."""
    newest = F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("timestamp"), F.desc("progress_data")))
    kept = points.withColumn("__n", newest).where(F.col("__n") <= keep).drop("__n")
    ident = F.concat_ws("_", "task_id", F.unix_timestamp(F.col("timestamp").cast("timestamp")).cast("string"))
    return kept.withColumn("checkpoint_id", ident).withColumn("checksum", checkpoint_checksum())


def verified_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints whose checksum is that of their content."""
    return checkpoints.where(F.col("checksum") == checkpoint_checksum())


def write_checkpoints(checkpoints: DataFrame, path: str) -> None:
    """Appends checkpoints as JSON lines."""
    checkpoints.write.mode("append").json(path)


def without_checkpoints(checkpoints: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Checkpoints whose keys (checkpoint_id: single ones, task_id: all of a task) aren't among the gone."""
    return checkpoints.join(gone.select(*keys), list(keys), "left_anti")


def checkpoint_statistics(checkpoints: DataFrame) -> DataFrame:
    """One row: checkpoints, tasks with one, bytes and MB (2 places) of their JSON."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in checkpoints.columns])))), F.lit(0))
    return checkpoints.agg(F.count("*").alias("total_checkpoints"), F.count_distinct("task_id").alias("total_tasks"), size.alias("bytes")).withColumn("mb", F.round(F.col("bytes") / F.lit(1048576.0), 2))


def recovery_plan(failures: DataFrame, attempts: DataFrame, checkpoints: DataFrame, retry_on: tuple[str, ...] = (), stop_on: tuple[str, ...] = ()) -> DataFrame:
    """failures(task_id, task_name, exception_type) with task_type, tries, has_checkpoint and strategy.

    stop: the exception is one of stop_on; give_up: as many tries (attempts that aren't skips) as the type allows; resume: a checkpoint is
    there and used; retry: the exception is one of retry_on; else the type's strategy. Unknown types go by the defaults 3 tries, retry, checkpoints.
    delay_s grows by the type's factor with each try, to LONGEST_DELAY_S at most.
    """
    tries = attempts.where("strategy <> 'skip'").groupBy("task_id").agg(F.count("*").alias("tries"))
    saved = checkpoints.select("task_id").distinct().withColumn("has_checkpoint", F.lit(True))
    kind = task_type(F.col("task_name"))
    out = failures.withColumn("task_type", kind).join(tries, "task_id", "left").join(saved, "task_id", "left")
    out = out.withColumns({"tries": F.coalesce("tries", F.lit(0)), "has_checkpoint": F.coalesce("has_checkpoint", F.lit(False))})
    setting = lambda i, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in RECOVERY.items() for x in (k, v[i])]), F.col("task_type")), F.lit(default))
    has = lambda words: F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.col("exception_type").contains(w)), F.lit(False)) if words else F.lit(False)
    strategy = (
        F.when(has(stop_on), "stop").when(F.col("tries") >= setting(0, 3), "give_up").when(setting(4, True) & F.col("has_checkpoint"), "resume")
        .when(has(retry_on), "retry").otherwise(setting(3, "retry"))
    )
    delay = F.least(setting(1, 60) * F.pow(setting(2, 2.0), F.col("tries")), F.lit(LONGEST_DELAY_S))
    return out.withColumn("strategy", strategy).withColumn("delay_s", delay)


def due_retries(attempts: DataFrame, as_of: str) -> DataFrame:
    """Pending attempts whose next retry time has come."""
    return attempts.where((F.col("status") == "pending") & (F.col("next_retry") <= F.lit(as_of).cast("timestamp")))


def recovery_statistics(attempts: DataFrame) -> DataFrame:
    """A row for each strategy and, with strategy null, for all: tasks, attempts, successes, failures and the share of successes in percent."""
    out = attempts.rollup("strategy").agg(F.grouping_id().alias("__all"), F.count_distinct("task_id").alias("tasks"), F.count("*").alias("attempts"), F.count_if("success").alias("successful"))
    return out.withColumn("failed", F.col("attempts") - F.col("successful")).withColumn("success_percent", percent(F.col("successful"), F.col("attempts"))).withColumn("of_all", F.col("__all") == 1).drop("__all")


def resume_status(tasks: DataFrame, resumes: DataFrame) -> DataFrame:
    """task_id, is_resumed_task, other_task_id, checkpoint_id and status of the resumed task, for tasks on either side of a resume.

    resumes: new_task_id, original_task_id, checkpoint_id, resumed_at. A task that resumes another counts as that; of several resumes of a
    task the first counts (resumed_at, new_task_id). A new task without a row in tasks is unknown.
    """
    states = tasks.groupBy(F.col("task_id").alias("new_task_id")).agg(F.max("status").alias("status"))
    known = resumes.join(states, "new_task_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    rest = ["checkpoint_id", "resumed_at", "status"]
    new = known.select(F.col("new_task_id").alias("task_id"), F.lit(True).alias("is_resumed_task"), F.col("original_task_id").alias("other_task_id"), *rest)
    old = known.select(F.col("original_task_id").alias("task_id"), F.lit(False).alias("is_resumed_task"), F.col("new_task_id").alias("other_task_id"), *rest)
    first = F.struct((~F.col("is_resumed_task")).alias("a"), F.col("resumed_at").alias("b"), F.col("other_task_id").alias("c"))
    fields = F.struct("is_resumed_task", "other_task_id", *rest)
    return new.unionByName(old).groupBy("task_id").agg(F.min_by(fields, first).alias("r")).select("task_id", "r.*")


def open_resumes(tasks: DataFrame, resumes: DataFrame) -> DataFrame:
    """Resumes whose new task hasn't ended."""
    ended = tasks.where(F.col("status").isin(*DONE)).select(F.col("task_id").alias("new_task_id"))
    return resumes.join(ended, "new_task_id", "left_anti")


def resume_statistics(tasks: DataFrame, resumes: DataFrame) -> DataFrame:
    """One row: resumes, ended well and badly, with and without a checkpoint, share of successes."""
    states = tasks.groupBy(F.col("task_id").alias("new_task_id")).agg(F.max("status").alias("status"))
    out = resumes.join(states, "new_task_id", "left").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("completed"), F.count_if(F.col("status") == "failure").alias("failed"),
        F.count_if(F.coalesce(F.col("checkpoint_id"), F.lit("")) != "").alias("with_checkpoint"),
    )
    return out.withColumn("restarts", F.col("total") - F.col("with_checkpoint")).withColumn("success_rate", F.coalesce(F.try_divide("completed", "total"), F.lit(0.0)))


def all_tasks(active: DataFrame, ended: DataFrame) -> DataFrame:
    """History and active tasks together, nothing left out; columns that one side lacks are null."""
    return ended.unionByName(active, allowMissingColumns=True)
