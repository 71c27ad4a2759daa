"""Ranks, alerts, errors, recovery and page fields against plain Python."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarnweave.operators import monitoring, operations, ranks, recovery
from tarnweave.sources import pages


def test_percentiles_of_hot_and_null_keys(spark):
    rows = [("hot", float(i % 700)) for i in range(4000)] + [(None, float(i)) for i in range(7)] + [("one", 3.0), ("none", None)] + [("same", 5.0)] * 50
    df = spark.createDataFrame(rows, "k string, value double")
    values = defaultdict(list)
    for k, v in rows:
        if v is not None:
            values[k].append(v)
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99, "low": 0.0, "high": 1.0}

    def expected(v, share):
        v, place = sorted(v), (len(v) - 1) * share
        return v[math.floor(place)] + (v[math.ceil(place)] - v[math.floor(place)]) * (place - math.floor(place))

    found = {r.k: r for r in ranks.percentiles(df, ["k"], shares).collect()}
    assert set(found) == set(values)
    for k, v in values.items():
        assert found[k].n == len(v)
        assert [found[k][name] for name in shares] == pytest.approx([expected(v, s) for s in shares.values()])
    assert ranks.nearest_ranks(df, ["k"], {"x": 0.95}).where("k = 'hot'").first().x == sorted(values["hot"])[math.floor(4000 * 0.95)]
    assert ranks.percentiles(df, [], {"median": 0.5}).first().n == sum(map(len, values.values()))
    assert ranks.percentiles(df.limit(0), ["k"], {"median": 0.5}).count() == 0


def test_request_report(spark):
    df = spark.createDataFrame([("a", 200, 1.0, 10), ("a", 500, 3.0, 20), (None, 404, 2.0, 30), ("a", 200, 9.0, 99999)], "endpoint string, status_code int, response_time double, ago long")
    df = df.withColumn("timestamp", F.expr("TIMESTAMP '2024-01-01 00:00:00' - make_interval(0, 0, 0, 0, 0, 0, ago)"))
    found = {r.endpoint: r for r in monitoring.request_report(df, "2024-01-01 00:00:00", 5, "endpoint").collect()}
    assert (found["a"].n, found["a"].status_codes, found["a"].success_percent, found["a"].requests_per_minute) == (2, "200=1,500=1", 50.0, 0.4)
    assert (found[None].n, found[None].p99_time) == (1, 2.0)


def test_alert_cycle(spark):
    steps = [(0, "resolve"), (1, "acknowledge"), (10, "fire"), (20, "fire"), (30, "acknowledge"), (400, "fire"), (500, "resolve"), (501, "resolve"), (600, "fire")]
    df = spark.createDataFrame([("r", i, t, what, f"u{i}") for i, (t, what) in enumerate(steps)], "rule_id string, id long, t long, what string, who string").withColumn("timestamp", F.timestamp_seconds("t"))
    first, second = operations.alert_cycle(df, 300.0).orderBy("episode").collect()
    assert (first.fires, first.sent, first.status, first.acknowledged_by, first.resolved_by) == (3, 2, "resolved", "u4", "u6")
    assert (second.episode, second.fires, second.sent, second.status, second.acknowledged_at) == (2, 1, 1, "active", None)
    assert operations.alert_cycle(df.limit(0)).count() == 0


def test_histogram_without_values(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.5), ("b", 9.0), ("c", None)], "k string, value double")
    found = {r.k: r.quantile for r in operations.histogram_quantile(operations.histogram_buckets(df, [1.0, 2.0], "k"), 0.5, "k").collect()}
    assert found == {"a": 1.0, "b": 2.0}


def test_reopened_errors(spark):
    df = spark.createDataFrame([("x", "T", "high", 1, 1), ("x", "T", "high", 5, 2), ("y", "T", "low", 1, 3)], "fingerprint string, error_type string, severity string, t long, id long").withColumn("timestamp", F.timestamp_seconds("t"))
    closed = spark.createDataFrame([("x", 3, "resolved"), ("y", 3, "ignored")], "fingerprint string, t long, status string").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    found = {r.fingerprint: (r.status, r.reopened) for r in operations.error_events(df.drop("t"), closed).collect()}
    assert found == {"x": ("open", True), "y": ("ignored", False)}


def test_checkpoints_written_and_verified(spark, tmp_path):
    df = spark.createDataFrame([("t", "crawler", "5", "run", i) for i in range(4)] + [("u", None, None, "run", 1)], "task_id string, task_name string, progress_data string, state_data string, s long")
    points = recovery.with_checkpoint_ids(df.select("*", F.timestamp_seconds("s").alias("timestamp")).drop("s"), keep=3)
    recovery.write_checkpoints(points, str(tmp_path / "points"))
    read = spark.read.schema(points.schema).json(str(tmp_path / "points"))
    assert recovery.verified_checkpoints(read).count() == 4
    assert recovery.verified_checkpoints(read.withColumn("state_data", F.lit("other"))).count() == 0
    assert recovery.checkpoint_statistics(read).first().bytes > 0


PAGE = """<div class="category-list"><a href="/x">no</a><a href="/chanpin/1.html"> Rings </a></div><div class="d-title"><h1>1234</h1><span class="title-text">A blue ring</span></div>
<span class="price">7</span><div class="d-price"><b class="price">¥ 12.5</b><s class="price-del">¥20</s></div><div class="d-seller" ><a class="seller-name" data-id=" 77 ">Ann &amp; Co</a><i class="location"> Oslo</i></div>
<p class="offer-brand">Blau</p><p class="desc-content">A ring<br>of glass</p><div class="offer-item"><p class="offer-title"><a href="p/1.html">1</a><a href="https://x/2.html">2</a></p></div>
<div class="list-item"><p class="title"><a href="/never">n</a></p></div><div class="pagination"><b class="next"><a href="?page=3">next</a></b></div><a href="/s?beginPage=3">3</a>"""


def test_page_fields(spark):
    df = spark.createDataFrame([(1, "http://h/list?beginPage=2", PAGE), (2, None, None), (3, "http://h/", "<p>" * 3000 + "x" + "<a href='//['>y</a>")], "page_id long, url string, html string")
    items = pages.extract_items(df)
    a, b, c = items.orderBy("page_id").collect()
    assert (a.title, a.price, a.original_price, a.description, a.brand) == ("A blue ring", 12.5, 20.0, "A ring", "Blau")
    assert (a.seller, a.location, a.seller_id, a.shows_product) == ("Ann & Co", "Oslo", "77", True)
    assert (b.title, b.seller_id, b.shows_product, b.product_links) == ("", None, False, []) and not c.shows_product
    found = {(r.kind, r.place): (r.name, r.link) for r in pages.requests_of(items).collect()}
    assert found == {
        ("product", 0): (None, "http://h/p/1.html"), ("product", 1): (None, "https://x/2.html"), ("category", 0): ("Rings", "http://h/chanpin/1.html"),
        ("next_of_search", 0): (None, "http://h/s?beginPage=3"), ("next_of_category", 0): (None, "http://h/list?page=3"),
    }
    counted = pages.crawl_counters(items).first()
    assert (counted.pages, counted.products, counted.items, counted.no_title) == (3, 1, 1, 2)
