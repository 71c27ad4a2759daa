"""Streams that keep state for each key: progress of tasks, alerts' life cycle, error groups.

A fold takes a key's rows in order of (ts, id), whatever order and batches they come in: rows wait in list state until the watermark has
passed them, an event-time timer wakes the key, and what has become due is folded. A second timer ends the state when its time to
live is over, so state never outlasts it. Rows behind the watermark are dropped by Spark and bring nothing back; rows later than the
end of a state begin a new one, named by the first row (since, first_id). What is kept is small: no fold keeps more than HISTORY points,
and of an ended state nothing.

Each fold emits the states that a batch changed; `Run.states` reads the last of each, as files named by batch, so a batch that is
repeated after a failure replaces its own. A mark (a row that is only a time) moves the watermark on after the last row, so that all is due.

Null keys are a key like others, null times never become due and are left out, rows that are equal in ts and id go in order of their other columns.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Points of a task's progress that its speed is taken from; seconds after which an ended task, and an error group without news, go.
HISTORY, TASK_LIVES_S, GROUP_LIVES_S = 10, 3600, 24 * 3600
ENDED = ("completed", "failed", "revoked")
#: What names a state, and what every fold shows.
NAMED = "key string, since timestamp, first_id long, last_seen timestamp, removed boolean"


@dataclass(frozen=True)
class Fold:
    """What a key's rows become. A row that doesn't start a state is passed over where there is none."""

    fields: str  # of a row, beside key, ts and id
    columns: str  # that show gives
    step: Callable[[dict | None, dict], dict]
    show: Callable[[dict], list]
    starts: Callable[[dict], bool] = lambda row: True
    ends: Callable[[dict], bool] = lambda state: False  # at once
    lives: Callable[[dict], float | None] = lambda state: None  # seconds after its last row, or None: for ever


def names_of(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def seconds_between(a: int, b: int) -> float:
    return (b - a) / 1e6


def _time(micros: int | None) -> pd.Timestamp | None:
    return None if micros is None else pd.Timestamp(micros, unit="us")


class Ordered(StatefulProcessor):
    """Runs a fold over each key's rows in order of event time."""

    def __init__(self, fold: Fold):
        self.fold = fold
        self.fields = names_of(fold.fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row string")
        self.folded = handle.getValueState("folded", "last long, since long, first_id long, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        soonest = None
        for batch in rows:
            new = []
            for r in batch.loc[~batch["is_mark"], ["at", "id", *self.fields]].itertuples(index=False):
                values = [None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r[1:]]
                new.append((int(r[0]), json.dumps(values)))
            if new:
                self.waiting.appendList(new)
                soonest = min([a for a, _ in new] + ([] if soonest is None else [soonest]))
        if soonest is not None:
            self.handle.registerTimer(-(-soonest // 1000))
        yield from ()

    def _ends(self, last: int, state: dict) -> int | None:
        lives = self.fold.lives(state)
        return None if lives is None else last + int(lives * 1e6)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last, since, first_id, state = self.folded.get() if self.folded.exists() else (0, 0, 0, "")
        state = json.loads(state) if state else None
        due, later = [], []
        for at, row in self.waiting.get():
            (due if at <= now else later).append((at, row))
        out = []
        for at, row in sorted(due, key=lambda x: (x[0], [(v is not None, v) for v in json.loads(x[1])])):
            ends = self._ends(last, state) if state else None
            if state and ends is not None and ends < at:
                out.append((since, first_id, last, True, state))
                state = None
            values = json.loads(row)
            row = {"at": at, "id": values[0]} | dict(zip(self.fields, values[1:]))
            if not state and not self.fold.starts(row):
                continue
            if not state:
                since, first_id = at, row["id"]
            state, last = self.fold.step(state, row), at
            if self.fold.ends(state):
                out.append((since, first_id, last, True, state))
                state = None
        ends = self._ends(last, state) if state else None
        over = ends is not None and ends <= now
        if state and (due or over):
            out.append((since, first_id, last, over, state))
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(-(-min(a for a, _ in later) // 1000))
        if over or not state:
            self.folded.clear()
        elif due:
            self.folded.update((last, since, first_id, json.dumps(state)))
            if ends is not None:
                self.handle.registerTimer(-(-ends // 1000))
        if out:
            rows = [(key[0], _time(first), number, _time(at), gone, *self.fold.show(s)) for first, number, at, gone, s in out]
            yield pd.DataFrame(rows, columns=names_of(f"{NAMED}, {self.fold.columns}"))

    def close(self) -> None:
        pass


def with_states(events: DataFrame, fold: Fold, delay: str = "0 seconds") -> DataFrame:
    """key, since, first_id, last_seen, removed and the fold's columns from a stream of key string, ts timestamp, id long, is_mark boolean and the fold's fields."""
    # a filter on is_mark here would be pushed below the watermark, which then wouldn't see the marks
    own = events.where("ts IS NOT NULL").withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    return own.groupBy("key").transformWithStateInPandas(Ordered(fold), f"{NAMED}, {fold.columns}", "Update", "EventTime")


class Run:
    """A stream with states: its checkpoint and its sink live in one folder, from which it goes on after a stop."""

    def __init__(self, spark: SparkSession, folder: str, events: Callable[[], DataFrame], fold: Fold, delay: str = "0 seconds"):
        self.spark, self.folder, self.events, self.fold, self.delay = spark, folder, events, fold, delay
        spark.createDataFrame([], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/marks")

    def mark_at(self, time: dt.datetime) -> None:
        """Let the stream's time reach `time` in its next run: of two marks in a batch each, the first moves the watermark, the second lets timers see it."""
        for more in (0, 1):
            self.spark.createDataFrame([(time + dt.timedelta(milliseconds=more),)], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{self.folder}/marks")

    def go(self) -> None:
        """Take in what there is now, from where the last run ended."""
        events = self.events()
        own = events.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), *[F.col(c) for c in Ordered(self.fold).fields], F.lit(False).alias("is_mark"))
        marks = self.spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/marks").withColumn("is_mark", F.lit(True))
        stream = with_states(own.unionByName(marks, allowMissingColumns=True), self.fold, self.delay)
        folder, before = self.folder, self.spark.conf.get(PROVIDER, None)

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

        self.spark.conf.set(PROVIDER, ROCKS)
        try:
            query = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).start()
            query.awaitTermination()
            self.progress = [json.loads(p.json) for p in query.recentProgress]
        finally:
            if before is None:
                self.spark.conf.unset(PROVIDER)
            else:
                self.spark.conf.set(PROVIDER, before)

    def states(self) -> DataFrame:
        """Every state as it was last."""
        rows = self.spark.read.schema(f"{NAMED}, {self.fold.columns}, batch long").parquet(f"{self.folder}/states")
        names = ["key", "since", "first_id"]
        rest = [c for c in rows.columns if c not in (*names, "batch")]
        return rows.groupBy(*names).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*names, "s.*")


# Progress of tasks ----------------------------------------------------------------------------------------------------
def _progress_step(state: dict | None, row: dict) -> dict:
    state = state or {"points": 0, "history": []}
    history = [*state["history"], [row["at"], row["current"]]][-HISTORY:]
    return {"points": state["points"] + 1, "history": history, "total": row["total"], "status": row["status"]}


def _speed(history: list) -> float | None:
    span = seconds_between(history[0][0], history[-1][0])
    return (history[-1][1] - history[0][1]) / span if len(history) > 1 and span > 0 else None


def _progress_show(state: dict) -> list:
    history = state["history"]
    speed = _speed(history)
    left = state["total"] - history[-1][1]
    instant = _speed(history[-3:]) if len(history) > 2 else None
    return [state["points"], history[-1][1], state["total"], state["status"], speed, instant, left / speed if speed and speed > 0 and state["total"] > 0 and left > 0 else None]


#: A task's points, last value, speeds over its last points and seconds left; it goes an hour after the last point of an ended one.
PROGRESS = Fold(
    "current double, total double, status string",
    "points int, current double, total double, status string, avg_speed double, instant_speed double, seconds_left double",
    _progress_step, _progress_show, lives=lambda s: TASK_LIVES_S if s["status"] in ENDED else None,
)


# Alerts ---------------------------------------------------------------------------------------------------------------
def _alert_show(alert: dict) -> list:
    status = "resolved" if alert["end"] is not None else "acknowledged" if alert["ack"] is not None else "active"
    return [_time(alert["since"]), alert["fires"], alert["sent"], status, _time(alert["ack"]), alert["ack_by"], _time(alert["end"]), alert["end_by"]]


def alerts_fold(cooldown_s: float = 300.0) -> Fold:
    """A rule's alerts, each a generation: opened by a fire, ended by a resolve, sent at opening and at fires after each cooldown."""

    def step(alert: dict | None, row: dict) -> dict:
        alert = dict(alert or {"since": row["at"], "fires": 0, "sent": 0, "sent_at": None, "ack": None, "ack_by": None, "end": None, "end_by": None})
        if row["what"] == "fire":
            alert["fires"] += 1
            if alert["sent_at"] is None or seconds_between(alert["sent_at"], row["at"]) >= cooldown_s:
                alert["sent"], alert["sent_at"] = alert["sent"] + 1, row["at"]
        elif row["what"] == "acknowledge":
            alert["ack"], alert["ack_by"] = row["at"], row["who"]
        elif row["what"] == "resolve":
            alert["end"], alert["end_by"] = row["at"], row["who"]
        return alert

    columns = "triggered_at timestamp, fires int, sent int, status string, acknowledged_at timestamp, acknowledged_by string, resolved_at timestamp, resolved_by string"
    return Fold("what string, who string", columns, step, _alert_show, starts=lambda r: r["what"] == "fire", ends=lambda s: s["end"] is not None)


# Error groups ---------------------------------------------------------------------------------------------------------
def _group_step(state: dict | None, row: dict) -> dict:
    state = state or {"n": 0, "first": row["at"], "status": "open", "reopened": 0}
    if row["what"] != "error":
        return state | {"status": row["what"]}
    return state | {"n": state["n"] + 1, "status": "open", "reopened": state["reopened"] + (state["status"] != "open")}


#: Occurrences of a fingerprint, its status (open, or what closed it), and how often an error opened it again; it goes a day after its last row.
ERROR_GROUPS = Fold(
    "what string", "occurrences int, first_seen timestamp, status string, reopened int",
    _group_step, lambda s: [s["n"], _time(s["first"]), s["status"], s["reopened"]],
    starts=lambda r: r["what"] == "error", lives=lambda s: GROUP_LIVES_S,
)
