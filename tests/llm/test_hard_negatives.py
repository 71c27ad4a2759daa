"""Operator 12 against brute force on small blocks, so that every row, chunk and tile border is met, and the edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnweave.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=10):
    """rows: (vec_id, label, vector of integers) in any order."""
    rows, out = list(enumerate(rows)), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for at, (anchor, label, vector) in rows:
        if anchor % 100:
            continue
        scored = sorted((-dot(vector, r[2]), r[0], k, r[1]) for k, r in rows if k != at)
        for score, pid, *_ in [s for s in scored if s[3] == label][:positives]:
            p = -score
            fitting = [s for s in scored if s[3] != label and 30 * p <= -100 * s[0] <= 90 * p][:negatives]
            out += [(anchor, pid, k + 1, s[1], p, -s[0]) for k, s in enumerate(fitting)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    for name, value in {"ANCHOR_BLOCK": 3, "ROW_BLOCK": 16, "CHUNK": 3, "CHUNKS": 4}.items():
        monkeypatch.setattr(hn, name, value)


@pytest.mark.parametrize("seed", [1, 2])
def test_small_blocks(spark, small, seed):
    chance = random.Random(seed)
    rows = [(100 * k if k < 9 else 1000 + k, chance.choice([1, 1, 1, 2, 3]), [chance.randint(-3, 9) for _ in range(chance.choice([10, 10, 10, 4, 0]))]) for k in range(120)]
    rows += rows[:12]  # repeated rows, anchors among them
    found = hn.hard_negatives(spark.createDataFrame(rows, "vec_id long, label long, vector array<long>"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.4]), (2, 2, [0.5, 0.2]), (3, 2, [0.004, -0.001]), (7, 1, [0.5, 0.5]), (100, None, [1.0, 1.0]), (200, 1, None), (300, 1, [nan, 1.0]), (400, 1, [inf, 1.0]), (500, 1, [None, 1.0]), (None, 2, [0.5, 0.2]), (600, 5, [1.0, 1.0]), (8, 3, [])]
    raw = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, label int, embedding array<float>, rank string, negative_id int")
    whole = [(k, (label + 1) % 10 if k % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]) for k, label, v in rows if None not in (k, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    as_float = spark.createDataFrame([(k, v) for k, _, v in rows if v], "k long, v array<float>")
    exact = {r.k: [math.floor(256 * x) for x in r.v] for r in as_float.collect() if r.k in (0, 1, 2, 3, 7, 600)}
    whole = [(k, label, exact.get(k, v)) for k, label, v in whole]
    run = lambda df: sorted(map(tuple, hn.hard_negatives(hn.quantised(df), F.col("vec_id") % 100 == 0).collect()))
    assert run(raw) == brute(whole)
    assert run(raw.where("false")) == [] and run(raw.where("vec_id = 600")) == []
    # sums beyond the exact range of floating point
    big = [(k, k % 2, [2**27 + k, -(2**26) + 3 * k, k]) for k in range(40)]
    found = hn.hard_negatives(spark.createDataFrame(big, "vec_id long, label long, vector array<long>"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == brute(big)


def test_long_vectors(spark):
    rows = [(k, k % 3, [(k * j) % 7 for j in range(3000)]) for k in range(30)]
    found = hn.hard_negatives(spark.createDataFrame(rows, "vec_id long, label long, vector array<long>"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows)
