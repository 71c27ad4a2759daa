"""Operator 13 against brute force: every run, every digest of the query, and the edges."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnweave.llm import word_runs
from tarnweave.llm.queries import QUERIES


def brute(words, min_length=6, min_exponent=4):
    """Runs by trying every period and every stretch of equal words that far apart."""
    n, found = len(words), []
    for p in range(1, n // min_exponent + 1):
        if not any(words[i] == words[i + p] for i in range(n - p)):
            continue
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            own = words[i : j + p] if j - i + p >= max(min_length, min_exponent * p) else []
            if j > i and own and not any(own[q:] == own[:-q] for q in range(1, p)):
                found.append((i, len(own), p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    dropped = {k for s, n, p in runs for k in range(s + p, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=4), st.sampled_from([(6, 4), (2, 2), (6, 3), (1, 2), (9, 5)]))
def test_runs(texts, limits):
    assert word_runs.runs_of_texts(texts, *limits) == [brute(t, *limits) for t in texts]


def test_long_periodic_text():
    words = [str(k % 3000 if k < 40_000 else k).encode() for k in range(50_000)]
    assert word_runs.runs_of_texts([words[:17], words]) == [[], [(0, 40_000, 3000)]]
    assert word_runs.runs_of_texts([[b"x"] * 300_000]) == [[(0, 300_000, 1)]]


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op13_word_runs"](spark, data)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(expected(r.doc_id, r.text) for r in rows)


def test_edges(spark, tmp_path):
    chance = random.Random(1)
    texts = [None, "", " \t\r\n", "a", "a " * 6, "a\x0ba\x0ca\na\ta\ra", "a\xa0" * 9, "é a é a é a é a\x00b", "x " * 400, "a b " * 200 + "c", " ".join(chance.choice("ab") for _ in range(200)), "a a a a a"]
    rows = [(k, t, "r", "n", 7) for k in [*range(20), 3, 3, None] for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words string, lang long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known = {k: expected(*k) for k in {r[:2] for r in rows}}
    found = QUERIES["op13_word_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((known[r[:2]] for r in rows), key=repr)
    own = word_runs.with_runs(docs.where("doc_id = 3 AND text LIKE 'a a a a a a%'")).first()  # clashing columns are replaced
    assert own.asDict(True) == {"doc_id": 3, "lang": 7, "n_words": 6, "runs": [{"start": 0, "length": 6, "period": 1}], "collapsed": "a"}
    assert word_runs.with_runs(docs.where(F.lit(False)), ["lang"]).count() == 0
