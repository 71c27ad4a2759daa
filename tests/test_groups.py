"""Similarity join, greedy groups in rounds, linked groups, prefix scans, imports and locale order, against plain Python."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnweave.catalogue import QUERIES
from tarnweave.operators import dedup, graph, imports, predicates, scans, text_join


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def pairs_of(titles, threshold):
    """Pairs of rows above the threshold by the rule itself; titles: by id."""
    return {(a, b) for a, b in combinations(sorted(titles), 2) if ratio(titles[a], titles[b]) > threshold}


def row_pairs(df, titles, threshold):
    """Pairs of rows from the join's classes."""
    classes = {}
    for r in text_join.members(df, "id", "title").collect():
        classes.setdefault(r.class_id, []).append(r.id)
    found = {p for own in classes.values() for p in combinations(sorted(own), 2)}
    for r in text_join.similar_texts(df, "id", "title", threshold).collect():
        assert (r.left_n, r.right_n) == (len(classes[r.left_id]), len(classes[r.right_id]))
        for x in classes[r.left_id]:
            for y in classes[r.right_id]:
                if (r.forward if x < y else r.backward) > threshold:
                    found.add((min(x, y), max(x, y)))
    return found


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_similar_texts(spark, threshold):
    chance = random.Random(3)
    base = ["red steel bolt with long thread", "Red steel bolt with short thread", "x", "", "ab", "abc", "abcdefghijkl", "aaaaaaaaaaaa", "abababababab"]
    titles = dict(enumerate(base))
    for k in range(len(base), 160):
        letters = list(titles[chance.randrange(k)])
        for _ in range(chance.randint(0, 3)):
            at = chance.randrange(len(letters) + 1)
            letters[at : at + chance.randint(0, 2)] = chance.choice(["", "a", "b ", "é"])
        titles[k] = "".join(letters)
    df = spark.createDataFrame([*titles.items(), (500, None), (None, "x")], "id long, title string")
    expected = pairs_of(titles, threshold)
    assert row_pairs(df, titles, threshold) == expected and len(expected) > 50
    assert text_join.similar_row_pairs(df, "id", "title", threshold).first().n == len(expected)
    if threshold == 0.9:
        texts = text_join.classes(df, "id", "title")
        assert text_join.candidates(texts).count() < texts.count() ** 2 / 3
        assert text_join.similar_row_pairs(df.where("false"), "id", "title").first().n == 0


def test_similar_titles_of_products(spark, data):
    df = spark.read.parquet(f"{data}/part.parquet").selectExpr("p_partkey AS id", "concat_ws(' ', p_name, p_brand, p_type) AS title")
    titles = {r.id: r.title for r in df.collect()}
    assert row_pairs(df, titles, 0.9) == pairs_of(titles, 0.9)
    assert QUERIES["similar_title_pairs"](spark, data).count() > 0


def sequential(links):
    """Groups by the rule: in order, an untaken row takes its untaken later neighbours."""
    taken, groups = set(), {}
    later = {}
    for a, b in links:
        later.setdefault(a, set()).add(b)
    for seed in sorted(later):
        mates = later[seed] - taken
        if seed not in taken and mates:
            groups[seed] = mates
            taken |= {seed, *mates}
    return groups


@pytest.mark.parametrize("finish", [0, 30, 10**6])
def test_greedy_groups_in_rounds(spark, finish):
    chance = random.Random(finish)
    hot = {(0, k) for k in range(1, 60)} | {(k, k + 1) for k in range(60)}  # one row linked to a third of all, and a chain
    links = hot | {tuple(sorted(chance.sample(range(180), 2))) for _ in range(120)}
    df = spark.createDataFrame([(a, b, 0.5 + a / 1000) for a, b in links], "left_id long, right_id long, similarity double")
    found = {}
    for r in graph.greedy_groups(df, finish).collect():
        assert r.similarity == (1.0 if r.id == r.seed_id else 0.5 + r.seed_id / 1000)
        if r.id != r.seed_id:
            found.setdefault(r.seed_id, set()).add(r.id)
    assert found == sequential(links)


RECORD = "id long, block string, title string, price_min double, price_max double, category_name string"


def record_rows():
    """Rows of few values, so that many are equal, some of them without any field, some keys with several records, and some without key or block."""
    chance = random.Random(11)
    titles = ["Blue ring", "blue  ring!", "Blue rings", "red bolt", "red bolts", "green rod", "!", "0", "", None, "ab" * 150, "ab" * 149 + "c"]
    rows = [(k, chance.choice("xyz"), chance.choice(titles), chance.choice([1.0, 2.0, 0.0, None]), chance.choice([3.0, None]), chance.choice(["c", "0", None])) for k in range(200)]
    rows += [(7, "x", "Blue ring", 1.0, 3.0, "c"), (7, "y", "red bolt", 2.0, None, None), (7, "x", "Blue ring", 1.0, 3.0, "c"), (90, "z", "green rod", 1.0, 3.0, "c")]
    rows += [(300 + k, "e", None, None, None, None) for k in range(3)] + [(None, "x", "Blue ring", 1.0, 3.0, "c"), (400, None, "Blue ring", 1.0, 3.0, "c"), (401, None, "Blue ring", 1.0, 3.0, "c")]
    chance.shuffle(rows)
    return rows


def score_of(a, b):
    """Similarity by the rule itself."""
    clean = lambda t: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", t.lower())).strip()
    score = weight = 0.0
    for w, x, y in zip((0.4, 0.3, 0.2, 0.1), a[2:], b[2:]):
        if x not in (None, "", "0") and y not in (None, "", "0"):
            same = SequenceMatcher(None, clean(x), clean(y)).ratio() if w == 0.4 else float(x == y)
            score, weight = score + same * w, weight + w
    return score / weight if weight else 0.0


def record_pairs(rows, threshold):
    """left, right, similarity of each pair of rows of a block above the threshold."""
    rows = sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0])
    return [(a[0], b[0], score_of(a, b)) for a, b in combinations(rows, 2) if a[0] < b[0] and a[1] == b[1] and score_of(a, b) >= threshold]


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.8])
def test_greedy_groups_of_records(spark, threshold):
    rows = record_rows()
    df = spark.createDataFrame(rows, RECORD)
    pairs = record_pairs(rows, threshold)
    expected = set()
    for seed, mates in sequential({p[:2] for p in pairs}).items():
        expected |= {(seed, seed, 1.0)} | {(seed, k, round(min(p[2] for p in pairs if p[:2] == (seed, k)), 9)) for k in mates}
    found = [(r.seed_id, r.id, round(r.similarity, 9)) for r in dedup.greedy_groups(df, F.col("block"), dedup.PRODUCT_WEIGHTS, threshold).collect()]
    assert set(found) == expected and len(found) == len(expected) > 100


def test_equal_records_are_not_paired(spark, monkeypatch):
    given, whole = [], graph.greedy_groups
    monkeypatch.setattr(graph, "greedy_groups", lambda links: given.append(links.count()) or whole(links))
    df = spark.range(600).selectExpr("id", "'b' AS block", "IF(id % 2 = 0, 'Blue ring', 'Blue rings') AS title", "1D AS price_min", "2D AS price_max", "'c' AS category_name")
    found = dedup.greedy_groups(df, F.col("block"), dedup.PRODUCT_WEIGHTS, 0.5)
    assert given == [1]  # by rows, 179 700
    assert found.count() == 600 and found.where("seed_id = 0").count() == 600
    assert {r.id % 2: r.similarity for r in found.where("id > 1").collect()} == {0: 1.0, 1: pytest.approx(0.6 + 0.4 * ratio("blue ring", "blue rings"))}


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.8])
def test_similar_pairs_of_records(spark, threshold):
    rows = record_rows()
    found = [(r.left_id, r.right_id, round(r.similarity, 9)) for r in dedup.similar_pairs(spark.createDataFrame(rows, RECORD), F.col("block"), dedup.PRODUCT_WEIGHTS, threshold).collect()]
    expected = [(a, b, round(s, 9)) for a, b, s in record_pairs(rows, threshold)]
    assert sorted(found) == sorted(expected) and len(expected) > 100


def test_equal_records_are_compared_once(spark, monkeypatch):
    compared = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counting(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    monkeypatch.setattr(dedup, "text_similarity", counting)
    # two titles at two prices: 150 rows each, and a title too short for any other
    df = spark.range(603).selectExpr("id", "'b' AS block", "CASE WHEN id >= 600 THEN 'x' WHEN id % 2 = 0 THEN 'Blue ring' ELSE 'Blue rings' END AS title", "CAST(id % 4 DIV 2 AS DOUBLE) + 1 + id DIV 600 AS price_min", "price_min + 1 AS price_max", "'c' AS category_name")
    found = dedup.similar_pairs(df, F.col("block"), dedup.PRODUCT_WEIGHTS, 0.5).select("left_id", "right_id").distinct().count()
    title, price = (lambda k: k % 2 if k < 600 else 2), (lambda k: k % 4 // 2 + k // 600)
    assert found == sum(title(a) == title(b) or price(a) == price(b) for a, b in combinations(range(603), 2))
    assert 0 < compared.value < 50  # by rows, 181 503


def test_hot_values_cost_a_link_each(spark):
    rows = [(k, "n" if k % 3 == 0 else f"n{k}", f"p{k // 50}" if k % 7 == 0 else None) for k in range(600)] + [(None, "n", "p"), (900, "", "")]
    df = spark.createDataFrame(rows, "id long, name string, phone string")
    links = dedup.equal_value_links(df, ("name", "phone"))
    assert links.count() <= 2 * len(rows)
    root = {k: k for k in range(600)}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for field in (1, 2):
        first = {}
        for r in rows[:600]:
            if r[field]:
                a, b = sorted((top(first.setdefault(r[field], r[0])), top(r[0])))
                root[b] = a
    sizes = Counter(top(k) for k in range(600))
    expected = {(k, top(k), sizes[top(k)]) for k in range(600) if sizes[top(k)] > 1}
    assert {tuple(r) for r in dedup.equal_value_groups(df, ("name", "phone")).collect()} == expected
    assert dedup.equal_value_groups(df.where("false"), ("name",)).count() == 0


@pytest.fixture
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # else small tables become one range
    yield
    spark.conf.unset(name)


def test_scans(spark, many_ranges):
    chance = random.Random(5)
    rows = [(chance.choice(["hot"] * 8 + ["b", None]), k * 7 % 501, k, chance.choice([None, 1.0, 2.5, -4.0])) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, at long, id long, v double").repartition(3)
    found = {r.id: r for r in scans.running(df, "key", ["at", "id"], total=("sum", F.col("v")), top=("max", F.col("v"))).collect()}
    ranges = scans.in_ranges(df, "key", "at", "id").where("key = 'hot'").select("__range").distinct().count()
    assert ranges > 1  # the hot key isn't in one task
    for key in ("hot", "b", None):
        total = top = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            if r[3] is not None:
                total, top = (total or 0) + r[3], r[3] if top is None else max(top, r[3])
            assert (found[r[2]].total, found[r[2]].top) == (total, top)
    names = spark.createDataFrame([(f"n{k % 40}", k) for k in range(203)], "name string, k long")
    batches = scans.batches(names, 10, "name").collect()
    assert Counter(Counter(r.batch for r in batches).values()) == {10: 20, 3: 1}
    ordered = sorted(batches, key=lambda r: (r.name, r.batch))
    assert [r.batch for r in ordered] == sorted(r.batch for r in batches)
    assert scans.numbered(names.where("false"), "name").count() == 0


def test_import(spark, tmp_path):
    schema = "source_id string, title string, price_min double, at long"
    known = spark.createDataFrame([("a", "old", 1.0, 0), ("z", "stays", 1.0, 0)], schema)
    rows = [("a", "new", 2.0, 1), ("a", "newest", 2.0, 2), ("a", None, 2.0, 3), ("b", "first", 1.0, 1), ("b", "first", 1.0, 1), (None, "no key", 1.0, 1), ("c", "bad price", -1.0, 1)]
    for update, outcome in ((True, ("a", "newest")), (False, ("a", "old"))):
        done = imports.import_rows(known, spark.createDataFrame(rows, schema), "source_id", "at", update_existing=update, folder=str(tmp_path))
        assert sorted((r.source_id, r.title) for r in done.table.collect()) == [outcome, ("b", "first"), ("z", "stays")]
        counts = done.counts.first().asDict()
        assert counts == {"total": 7, "rejected": 3, "repeated": 2, "kept": 0 if update else 1, "updated": 1 if update else 0, "inserted": 1, "success_rate": (2 if update else 1) / 7}
        assert sorted((r.source_id or "", any(v.level == "error" for v in r.validation)) for r in done.rejected.collect()) == [("", True), ("a", True), ("c", True)]
    none = imports.import_rows(known, known.where("false"), "source_id", "at", folder=str(tmp_path))
    assert none.table.count() == 2 and none.counts.first().total == 0 and none.counts.first().success_rate == 0


def test_locale_order(spark):
    words = ["Zebra", "apple", "Äpfel", "apfel", "zoo", "Éclair", "eclair", "ecru", None, "Apple"]
    df = spark.createDataFrame(list(enumerate(words)), "id long, w string")
    up = [r.w for r in df.orderBy(*predicates.locale_order(df, "w", tie="id")).collect()]
    assert up == ["apfel", "Äpfel", "apple", "Apple", "eclair", "Éclair", "ecru", "Zebra", "zoo", None]
    down = [r.w for r in df.orderBy(*predicates.locale_order(df, "w", descending=True, tie="id")).collect()]
    assert down == up[::-1]
    assert [r.id for r in df.orderBy(*predicates.locale_order(df, "id", descending=True)).collect()] == list(range(9, -1, -1))
