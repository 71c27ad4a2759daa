"""The page parser on broken pages, and exact percentiles both ways."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tarnweave.operators import operations, ranks, recovery, rows
from tarnweave.sources import pages, tables


@pytest.mark.parametrize("unit", ["<p>x", "<div class='d-title'>y", "</b><i>", "<td>z", "<ul class='tags'><li class=tag>t"])
def test_parser_takes_linear_time(unit):
    def seconds(n):
        began = time.process_time()
        parser = pages.ItemParser("https://base")
        parser.feed(unit * n)
        parser.close()
        return time.process_time() - began

    assert seconds(40_000) < 8 * seconds(10_000) + 1


def test_nested_selectors():
    parser = pages.ItemParser("https://base")
    parser.feed("<h1>One</h1><div class='x d-title'><div><h1>Two</h1></div></div><h1 class='d-title'>Three</h1></b><div class='d-tags'><p><span class='tag'>new</span></p></div>")
    assert parser.texts["h1"] == ["One", "Two", "Three"] and parser.texts[".d-title h1"] == ["Two"] and parser.tags == ["new"]


def test_percentiles_both_ways(spark, monkeypatch):
    chance = random.Random(4)
    df = spark.createDataFrame([(chance.choice(["a", "b", None]), chance.choice([None, *map(float, range(40))])) for _ in range(600)] + [("none", None)], "k string, value double")
    shares = {"median": 0.5, "p95": 0.95}
    plain = sorted(map(tuple, ranks.percentiles(df, ["k"], shares).collect()), key=repr)
    monkeypatch.setattr(ranks, "FEW_VALUES", 0)
    assert plain == sorted(map(tuple, ranks.percentiles(df, ["k"], shares).collect()), key=repr) and len(plain) == 3


def test_of_repeated_keys_the_newest_counts(spark):
    old = spark.createDataFrame([(1, "x")], "id long, name string")
    new = spark.createDataFrame([(1, "zz", 1), (1, "aa", 2), (2, "b", 1), (2, "a", 3)], "id long, name string, at long")
    assert [r.name for r in rows.updated_from(old, new, "id", "2024-01-01", order="at").collect()] == ["aa"]
    imported = tables.import_new(old.withColumn("at", F.lit(0).cast("long")), new, "id", order="at")
    assert sorted((r.id, r.name) for r in imported.collect()) == [(1, "x"), (2, "a")]


def test_error_rule_of_ten_minutes_and_longest_delay(spark):
    errors = spark.createDataFrame([("2024-01-01 11:49:00", "high"), ("2024-01-01 11:51:00", "high"), ("2024-01-01 12:00:00", "low")], "timestamp string, severity string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert operations.error_rule(errors, "2024-01-01 12:00:00", 600, 2).first().n == 2
    failures = spark.createDataFrame([("t", "data_sync run", "Timeout")], "task_id string, task_name string, exception_type string")
    attempts = spark.createDataFrame([("t", "retry")] * 9, "task_id string, strategy string")
    plan = recovery.recovery_plan(failures, attempts, failures.select("task_id").where("false"))
    assert plan.first().delay_s == 3600.0
