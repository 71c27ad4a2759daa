"""Operators that SQL doesn't check, against plain Python."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tarnweave.operators import dedup, predicates, series, tables, versions
from tarnweave.plans.products import process
from tarnweave.sources import pages, tables as sources
from tarnweave.streaming import events

PRODUCTS = "id long, source_id string, title string, price_min double, price_max double, category_name string"


def test_similar_pairs(spark):
    rows = [(1, "a", "Blue ring 10", 5.0, 6.0, "x"), (2, "a", "Blue rings 10", 5.0, 7.0, "x"), (3, "a", None, None, None, None), (4, "b", "Blue ring 10", 5.0, 6.0, "x")]
    df = spark.createDataFrame(rows, PRODUCTS)
    found = {(r.left_id, r.right_id): r.similarity for r in dedup.similar_pairs(df, F.lit("one"), dedup.PRODUCT_WEIGHTS, 0.5).collect()}
    near = SequenceMatcher(None, "blue ring 10", "blue rings 10").ratio()
    assert set(found) == {(1, 2), (1, 4), (2, 4)}
    assert found[1, 2] == pytest.approx(0.4 * near + 0.3 + 0.1) and found[1, 4] == pytest.approx(1.0)


def test_greedy_groups(spark):
    rows = [(i, "s", t, 1.0, 1.0, "c") for i, t in enumerate(["aaaa", "aaab", "aabb", "zzzz"])]
    found = dedup.greedy_groups(spark.createDataFrame(rows, PRODUCTS), F.col("source_id"), {"title": 1.0}, 0.7)
    assert sorted((r.seed_id, r.id) for r in found.collect()) == [(0, 0), (0, 1)]
    assert dedup.describe_groups(found).first()["size"] == 2


def test_rate_limit_and_cooldown(spark):
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate([0, 10, 20, 65, 66, 75, 400])], "id long, u string, t long").withColumn("t", F.timestamp_seconds("t"))
    accepted = [r.accepted for r in series.accepted_requests(df, "u", "t", "id", limit=2, window_s=60).orderBy("id").collect()]
    assert accepted == [True, True, False, True, False, True, True]
    assert [r.sent for r in series.sent_alerts(df, "u", "t", "id", 300).orderBy("id").collect()] == [True, False, False, False, False, False, True]


def test_error_trend_at_borders(spark, duck):
    """Fractions of a second after a border count as after it, errors after the given time are recent, as in the query's SQL."""
    from tarnweave.catalogue import ORACLE_SQL
    from tarnweave.catalogue.views import AS_OF_LOGS

    times = ["2024-01-28 23:59:59.9", "2024-01-29 00:00:00", "2024-01-29 00:00:00.000001", "2024-01-29 00:00:00.9", "2024-01-29 12:00:00", "2024-01-30 00:00:00", "2024-01-30 00:00:00.000001", "2024-01-30 00:00:00.5", "2024-01-31 00:00:00", "2024-01-31 00:00:00.5", "2024-02-03 00:00:00", None]
    rows = [(k, t, kind) for k, (t, kind) in enumerate((t, kind) for t in times for kind in ("error", "view"))]
    logs = spark.createDataFrame(rows, "id long, t string, kind string").selectExpr("CAST(t AS TIMESTAMP) AS timestamp", "IF(kind = 'error', 'ERROR', 'DEBUG') AS level")
    own = duck.cursor()
    own.sql("CREATE TEMP TABLE events (event_id BIGINT, ts TIMESTAMP, event_type VARCHAR, user_id BIGINT, value DOUBLE, props VARCHAR)")
    own.executemany("INSERT INTO events VALUES (?, ?, ?, 0, 0, '')", rows)
    expected = own.sql(ORACLE_SQL["error_trend_24h"]).fetchall()
    assert [tuple(r) for r in series.error_trend(logs, AS_OF_LOGS).collect()] == expected == [(5, 4, "increasing")]


def test_conditions():
    with pytest.raises(ValueError):
        predicates.condition({"a": {"near": 1}})


def test_one(spark):
    df = spark.range(3)
    assert predicates.one(df, {"id": 2}) == {"id": 2} and predicates.one(df, {"id": 9}) is None
    with pytest.raises(ValueError):
        predicates.one(df, {"id": [1, 2]})
    assert predicates.exists(df, {"id": 1}) and not predicates.exists(df, {"id": 7})


def test_delete_needs_confirmation(spark):
    with pytest.raises(ValueError):
        tables.delete_keys(spark.range(3), spark.range(1), "id")


def test_soft_delete_and_restore(spark):
    df = spark.range(3).withColumn("is_deleted", F.lit("N")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    gone = tables.soft_delete(df, F.col("id") == 1, "2024-01-01")
    assert predicates.live(gone).count() == 2 and predicates.live(tables.restore(gone, F.col("id") == 1)).count() == 3


def test_versions(spark):
    rows = [("p", "1", i, d) for i, d in enumerate([{"a": "1"}, {"a": "2", "b": "x"}, {"a": "2"}])]
    v = versions.with_changes(spark.createDataFrame(rows, "entity_type string, entity_id string, seq long, data map<string,string>"))
    assert [(r.change_type, r.changed_fields) for r in v.orderBy("seq").collect()] == [("create", ["a"]), ("update", ["a", "b"]), ("update", ["b"])]
    assert v.select("checksum").distinct().count() == 3


def test_process(spark):
    raw = spark.createDataFrame([("1", "ring", "¥5", "4"), ("2", "", "¥6", "9"), ("3", "bolt", "none", "3")], "source_id string, title string, price_text string, rating string")
    out = process(raw)
    assert out.rows.count() == 2 and out.rejected.count() == 1 and out.status() == "partial"
    assert {r.metric for r in out.reports["quality"].collect()} == {"completeness", "accuracy", "validity", "uniqueness", "consistency", "overall"}


def test_item_extraction(spark):
    html = '<html><body class="d"><div class="d-title"><h1> Blue ring </h1></div><div class="d-price"><span class="price">¥12.50</span></div><img src="//cdn/x.jpg"><img src="/icon50x50.png"><img src="/y.png">' '<div class="d-attributes"><table><tr><td>Color：</td><td>Blue</td></tr><tr><td></td><td>x</td></tr></table></div><div class="tags"><span class="tag"> new </span></div><a href="/p/5.html">n</a></body></html>'
    df = spark.createDataFrame([(1, "http://x/9.html", html), (2, None, None)], "page_id long, url string, html string")
    a, b = pages.extract_items(df, "https://base").orderBy("page_id").collect()
    assert (a.title, a.price, a.image_urls, a.links, a.specifications, a.tags, a.product_id) == ("Blue ring", 12.5, ["https://cdn/x.jpg", "https://base/y.png"], ["https://base/p/5.html"], {"Color": "Blue"}, ["new"], "9")
    assert (b.title, b.price, b.image_urls) == ("", None, [])


def test_json_logs_and_export(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00","level":"ERROR","message":"a","details":{"duration_ms":"5"}}\nnot json\n{"timestamp":"2024-01-03T00:00:00","level":"INFO","message":"b"}\n')
    logs = sources.json_logs(spark, str(tmp_path / "log.jsonl"))
    assert logs.count() == 2 and sources.json_logs(spark, str(tmp_path / "log.jsonl"), "2024-01-02").count() == 1
    for kind in ("json", "csv", "parquet"):
        sources.export(spark.range(5), str(tmp_path / kind), kind)
        assert spark.read.format(kind).option("header", "true").load(str(tmp_path / kind)).count() == 5
    with pytest.raises(ValueError):
        sources.export(spark.range(5), str(tmp_path / "x"), "xlsx")


def test_streams_equal_batch(spark, data):
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for build in (events.tumbling_counts, events.sliding_means, events.sessions):
        stream = events.run_to_end(build(events.event_stream(spark, data)), "complete", spark.conf.get("spark.checkpoint.dir"))
        assert sorted(map(repr, stream.collect())) == sorted(map(repr, build(batch).collect()))


def test_repeated_keys_of_updates(spark):
    """Updates, requests and upserts with a repeated key change a row once."""
    from tarnweave.operators import tables

    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, title string, price double")
    new = spark.createDataFrame([(1, "x", 5.0), (1, "y", 4.0), (1, "y", 4.0), (3, "z", 1.0), (3, "z", None)], "id long, title string, price double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.update_by_key(base, new, "id")) == [(1, "y", 4.0), (2, "b", 2.0)]
    assert rows(tables.coalescing_upsert(base, new, "id")) == [(1, "y", 4.0), (2, "b", 2.0), (3, "z", 1.0)]
    assert rows(tables.upsert(base, new, ["id"], "price")) == [(1, "x", 5.0), (2, "b", 2.0), (3, "z", 1.0)]
    assert rows(tables.upsert(base, new, ["id"])) == [(1, "y", 4.0), (2, "b", 2.0), (3, "z", 1.0)]
    tasks = spark.createDataFrame([(1, "running")], "task_id long, status string")
    wanted = spark.createDataFrame([(1, "failed"), (1, "failed"), (1, "completed")], "task_id long, status string")
    assert rows(tables.transition(tasks, wanted)) == [(1, "failed", True)]


def test_limits_over_batches_and_null_keys(spark):
    """Against plain Python, with a hot key, null keys and batches of few rows."""
    import random
    from datetime import datetime, timedelta

    from tarnweave.operators import series

    r = random.Random(3)
    given = [(i, r.choice(["hot"] * 6 + ["a", None]), datetime(2024, 1, 1) + timedelta(seconds=r.randrange(3000))) for i in range(600)]
    df = spark.createDataFrame(given, "id long, key string, at timestamp")
    accepted, sent, kept, last = {}, {}, {}, {}
    for i, k, t in sorted(given, key=lambda x: (x[2], x[0])):
        accepted[i] = sum(t - timedelta(seconds=60) < x for x in kept.setdefault(k, [])) < 3
        if accepted[i]:
            kept[k].append(t)
        sent[i] = k not in last or (t - last[k]).total_seconds() >= 90
        if sent[i]:
            last[k] = t
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {x.id: x.accepted for x in series.accepted_requests(df, "key", "at", "id", limit=3).collect()} == accepted
        assert {x.id: x.sent for x in series.sent_alerts(df, "key", "at", "id", cooldown_s=90.0).collect()} == sent
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_first_seen_keeps_null_keys(spark):
    from tarnweave.operators import dedup

    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id long, k string")
    assert sorted(x.id for x in dedup.first_seen(df, ["id"], "k").collect()) == [1, 2, 3]
