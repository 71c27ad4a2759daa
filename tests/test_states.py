"""Streams with state: the same result however the rows come, restarts, timers, late rows, bounded state; notifications once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnweave.operators import operations
from tarnweave.streaming import metrics, notify, states

START = dt.datetime(2024, 1, 1)
ROWS = "key string, ts timestamp, id long, current double, total double, status string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def source(spark, folder, schema, files_a_trigger=1):
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_progress_timer_and_late_rows(spark, tmp_path):
    folder = f"{tmp_path}/in"
    add(spark, folder, [("a", at(0), 1, 0.0, 100.0, "running"), ("a", at(10), 2, 20.0, 100.0, "completed"), ("b", at(5), 3, 1.0, 9.0, "running"), (None, at(6), 4, 1.0, 9.0, "running")], ROWS)
    run = states.Run(spark, f"{tmp_path}/run", source(spark, folder, ROWS), states.PROGRESS)
    run.go()
    add(spark, folder, [("b", at(5000), 5, 2.0, 9.0, "running")], ROWS)  # moves time past a's last hour
    run.go()
    run.mark_at(at(5001))
    run.go()
    gone = {r.key: r for r in run.states().collect()}
    assert gone["a"].removed and gone["a"].points == 2 and gone["a"].avg_speed == 2.0 and gone["a"].seconds_left == 40.0
    assert not gone["b"].removed and gone["b"].points == 2 and not gone[None].removed
    assert run.progress[-1]["stateOperators"][0]["numRowsTotal"] < 6
    add(spark, folder, [("a", at(20), 6, 30.0, 100.0, "running"), ("c", at(6000), 7, 1.0, 2.0, "failed")], ROWS)
    run.go()
    run.mark_at(at(50_000))
    run.go()
    again = run.states().where("key = 'a'").collect()
    assert len(again) == 1 and again[0].removed and again[0].points == 2  # the late row brought nothing back
    assert sorted((r.key or "", r.removed) for r in run.states().collect()) == [("", False), ("a", True), ("b", False), ("c", True)]


HAPPENED = "key string, ts timestamp, id long, what string, who string"


@pytest.mark.parametrize("files_a_trigger", [1, 5])
def test_alerts_as_in_batch(spark, tmp_path, files_a_trigger):
    chance = random.Random(files_a_trigger)
    rows = [(chance.choice("xyz"), at(60 * k // 3), k, chance.choice(["fire"] * 5 + ["acknowledge", "resolve"]), f"u{k}") for k in range(240)]
    folder = f"{tmp_path}/in"
    for k in range(0, 240, 40):  # in each part the rows are in no order
        part = rows[k : k + 40]
        chance.shuffle(part)
        add(spark, folder, part, HAPPENED)
        if k == 80:
            states.Run(spark, f"{tmp_path}/run", source(spark, folder, HAPPENED, files_a_trigger), states.alerts_fold(300.0)).go()  # stopped here
    run = states.Run(spark, f"{tmp_path}/run", source(spark, folder, HAPPENED, files_a_trigger), states.alerts_fold(300.0))
    run.go()
    run.mark_at(at(10**6))
    run.go()
    batch = operations.alert_cycle(spark.createDataFrame(rows, HAPPENED).withColumnsRenamed({"key": "rule_id", "ts": "timestamp"}), 300.0)
    columns = ["rule_id", "triggered_at", "fires", "sent", "status", "acknowledged_at", "acknowledged_by", "resolved_at", "resolved_by"]
    found = run.states().withColumnRenamed("key", "rule_id").select(*columns).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, batch.select(*columns).collect()), key=repr)


def test_error_groups_expire(spark, tmp_path):
    schema, folder = "key string, ts timestamp, id long, what string", f"{tmp_path}/in"
    hour = 3600
    rows = [(0, "resolved"), (1, "error"), (2, "resolved"), (3, "error"), (4, "error"), (30, "resolved"), (31, "error"), (60, "resolved")]
    add(spark, folder, [("f", at(h * hour), k, what) for k, (h, what) in enumerate(rows)], schema)
    run = states.Run(spark, f"{tmp_path}/run", source(spark, folder, schema), states.ERROR_GROUPS)
    run.go()
    run.mark_at(at(1000 * hour))
    run.go()
    found = [(r.since, r.occurrences, r.status, r.reopened, r.removed) for r in run.states().orderBy("since").collect()]
    assert found == [(at(hour), 3, "open", 1, True), (at(31 * hour), 1, "open", 0, True)]
    assert run.progress[-1]["stateOperators"][0]["numRowsTotal"] == 0  # nothing is left of ended groups


def test_histograms_merge(spark):
    points = spark.createDataFrame([(at(k * 37), float(k * k % 1300), "m") for k in range(400)] + [(at(0), None, "m"), (None, 1.0, "m")], "ts timestamp, value double, metric string")
    levels = metrics.levels(metrics.histograms(points, "metric"), "metric")
    day, direct = levels.where("level = 'day'").drop("level").collect(), metrics.histograms(points, "metric", size="1 day").collect()
    assert sorted(map(str, day)) == sorted(map(str, direct)) and sum(day[0].buckets) == day[0].n == 400
    one = spark.createDataFrame([(4, [0, 0, 4] + [0] * 8), (2, [0] * 10 + [2]), (2, [2] + [0] * 10)], "n long, buckets array<long>").select(metrics.quantile(0.5).alias("q"))
    assert [r.q for r in one.collect()] == [3.5, 1000.0, 0.5]


def test_notifications_once(spark, tmp_path):
    path, folder, schema = f"{tmp_path}/messages", f"{tmp_path}/in", "n long, message string"
    add(spark, folder, [(1, "a"), (2, "b")], schema)
    notify.send(source(spark, folder, schema)(), path, f"{tmp_path}/checkpoint")
    writer = notify.MessageWriter(path)
    lost = writer.write(iter([notify.Row(n=9, message="lost")]))
    writer.abort([lost, None], 7)  # a failed attempt leaves none
    left = writer.write(iter([notify.Row(n=8, message="of a task that failed")]))
    assert left.name
    writer.commit([writer.write(iter([notify.Row(n=1, message="a")]))], 0)  # batch 0 again sends nothing
    add(spark, folder, [(3, "c")], schema)
    notify.send(source(spark, folder, schema)(), path, f"{tmp_path}/checkpoint")  # a restart goes on after what was sent
    assert sorted((r.n, r.message, r.batch) for r in notify.sent(spark, path, schema).collect()) == [(1, "a", 0), (2, "b", 0), (3, "c", 1)]
    assert notify.sent(spark, path, schema).where(F.col("n") > 7).count() == 0
