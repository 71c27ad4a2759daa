"""Near copies: groups by five-word shingles at similarity 0.8, against brute force."""

import random

import corpus_pipeline as cp
import numpy as np
import pytest
from tarnweave.llm import near_copies
from tarnweave.llm.common import materialise, only_rows

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def copies():
    """Texts of 100 to 400 words and copies with 1 to 9 words replaced, chains of such, short and empty texts."""
    r = random.Random(7)
    word = lambda: "w%d" % r.randrange(5000)
    texts = ["", None, "one", "One ", "a b c d e f", "a b c d e g"]
    for _ in range(25):
        base = [word() for _ in range(r.randrange(100, 400))]
        for _ in range(4):
            texts.append(" ".join(base))
            for _ in range(r.randrange(1, 10)):
                base[r.randrange(len(base))] = word()
    return texts


def grams(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    for _ in range(len(texts)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("source", ["made", "documents"])
def test_stage_leaves_one_of_each_group(spark, data, source):
    if source == "made":
        texts = copies()
        docs = materialise(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC), "rows")
        ids = list(range(len(texts)))
    else:
        docs = spark.read.parquet(f"{data}/documents.parquet").select(*cp.COLUMNS)
        ids, texts = zip(*sorted((r.doc_id, r.text) for r in docs.collect()))
    root = components(texts)
    assert len(set(root)) < len(root)
    assert sorted(r.doc_id for r in cp.simhash_dedup(spark, docs, data).collect()) == [ids[i] for i in range(len(ids)) if root[i] == i]


def test_no_rows(spark):
    assert near_copies.near_copy_classes(materialise(spark.createDataFrame([], "row_no long, text string"), "none")).count() == 0


def test_edits_too_far_apart_are_not_paired(spark, monkeypatch):
    """Many edits of one text that share bands, but are no near copies: few pairs of them, and every group is found."""
    r = random.Random(3)
    base = ["w%d" % r.randrange(5000) for _ in range(150)]
    texts = [" ".join(base)]
    for i in range(300):
        own = list(base)
        for at in r.sample(range(2, 148), r.randrange(2, 7)):
            own[at] = "e%d" % r.randrange(10**6)
        texts.append(" ".join(own))
        if i % 20 == 0:
            own[r.randrange(150)] = "z"
            texts.append(" ".join(own))
    made, real = {}, near_copies.materialise

    def counted(df, name):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(near_copies, "materialise", counted)
    rows = materialise(spark.createDataFrame(list(enumerate(texts)), "row_no long, text string"), "rows")
    found = {x.row_no: x.component_id for x in near_copies.near_copy_classes(rows).collect()}
    assert [found[i] for i in range(len(texts))] == components(texts)
    assert made["pairs"].count() < 3 * len(texts)  # thousands when all nodes of a band are paired


def test_similar_edits_of_a_missing_text_are_not_all_paired(spark, monkeypatch):
    """Edits of one text that isn't there, many of them similar: a link for each, and pairs of those with edits in common only."""
    r = random.Random(11)
    base = ["w%d" % r.randrange(5000) for _ in range(150)]
    texts = []
    for i in range(400):
        own = list(base)
        for at in r.sample(range(2, 148), 1 + i % 3 if i > 3 else 4):  # the first, and so the hubs, are the furthest
            own[at] = "e%d" % r.randrange(10**6)
        texts.append(" ".join(own))
    made, real = {}, near_copies.materialise

    def counted(df, name):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(near_copies, "materialise", counted)
    rows = materialise(spark.createDataFrame(list(enumerate(texts)), "row_no long, text string"), "rows")
    found = {x.row_no: x.component_id for x in near_copies.near_copy_classes(rows).collect()}
    assert [found[i] for i in range(len(texts))] == components(texts)
    assert made["pairs"].count() < 5 * len(texts)


def test_group_links_are_whole(spark):
    """Sets around two centres and none, of several sizes: every similar pair of a group ends in one component."""
    r = random.Random(5)
    centres, groups, sets = [r.sample(range(10**6), n) for n in (9, 40, 120)], {}, {}
    for node in range(300):
        own = list(centres[node % 3])
        for _ in range(r.randrange(len(own) // 4 + 1)):
            own[r.randrange(len(own))] = r.choice([r.randrange(10**6), r.randrange(30)])
        own += r.sample(range(30), r.randrange(len(own) // 6 + 1))
        sets[node] = set(own)
        for hub in {0: (1, 2), 1: (1,), 2: (2, 3)}[node % 3]:
            groups.setdefault(hub, []).append(node)
    frame = lambda rows, schema, name: materialise(spark.createDataFrame(rows, schema), name)
    tables = frame([(k, bytearray(np.array(sorted(x), np.int64).tobytes())) for k, x in sets.items()], "node long, hashes binary", "sets")
    members = frame([(h, k) for h, nodes in groups.items() for k in nodes], "hub long, node long", "groups")
    deltas = near_copies.group_deltas(members, tables)
    sure = {(x.a, x.b) for x in near_copies.sure_links(deltas).collect()}
    similar = lambda a, b: len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])
    assert sure and all(similar(a, b) for a, b in sure)

    def joined(links):
        root = list(range(len(sets)))
        for _ in sets:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    parts = frame(list(enumerate(joined(sure))), "node long, component long", "parts")
    pairs = {(x.a, x.b) for x in near_copies.delta_pairs(deltas, parts).collect()}
    every = {(a, b) for nodes in groups.values() for a in nodes for b in nodes if a < b and similar(a, b)}
    assert joined(sure | {x for x in pairs if similar(*x)}) == joined(every)


@pytest.mark.parametrize("most", [8192, 0])
def test_rows_are_kept_by_number(spark, most):
    numbers = [-70000, -1, 0, 1, 7, 8, 32767, 32768, 32769, 1 << 40, (1 << 40) + 5, (1 << 62) + 3]
    rows = materialise(spark.createDataFrame([(n, str(n)) for n in numbers for _ in range(2)], "row_no long, text string"), "rows")
    for kept in (numbers[::2], numbers[1::2], numbers, []):
        table = materialise(spark.createDataFrame([(n,) for n in kept], "row_no long"), "kept")
        left = only_rows(rows, table, most=most)
        assert sorted((x.row_no, x.text) for x in left.collect()) == sorted((n, str(n)) for n in kept for _ in range(2))
        if most:
            assert "SortMergeJoin" not in left._jdf.queryExecution().toString()
