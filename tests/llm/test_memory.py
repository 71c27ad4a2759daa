"""What Python workers hold between tasks."""

import os

import pandas as pd
import pytest

import corpus_pipeline
from tarnweave.llm import common, toxicity
from tarnweave.llm.near_copies import shingle_set, with_sketches


def _resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_sketching_drops_the_memo_of_an_earlier_stage(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "")], "row_no long, text string")
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, function, schema: function)
    sketch = with_sketches(docs, keep=("row_no",))
    common.kept(("savings", 1), lambda: ["memo"])
    texts = ["a b c d e f", "", "g"]
    found = pd.concat(sketch(iter([pd.DataFrame({"row_no": [1, 2, 3], "__text": texts})])))
    assert found["row_no"].tolist() == [1, 2, 3] and found["n"].tolist() == [len(shingle_set(t)) for t in texts]
    assert common._kept == [None, None]


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="needs /proc")
def test_give_back_returns_the_memory():
    common.give_back()
    before = _resident_mb()
    common.kept(("test", 1), lambda: {i: "x" * 900 + str(i) for i in range(150_000)})
    above = "y" * 900  # pins the heap's top
    filled = _resident_mb()
    common.give_back(memo=False)
    assert common._kept[1][7].endswith("x7")
    common.give_back()
    assert filled - before > 120 and _resident_mb() - before < 40 and above


def test_training_holds_each_word_once(monkeypatch):
    got = []
    monkeypatch.setattr(toxicity, "trained", lambda samples, *rest: got.append(samples) or b"")
    monkeypatch.setattr(toxicity, "compressed_length", lambda content: len)
    rows = [(i % 2, False, f"Same words in every text{chr(97 + i)}") for i in range(8)]
    toxicity.train_both(rows)
    words = [w for samples in got for window in samples for w in window]
    assert len({id(w) for w in words}) == len(set(words))


def test_batches_are_bounded_by_bytes(spark):
    own = spark.newSession()
    docs = own.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 10000) AS text", "'en' AS lang", "'s' AS source", "10000L AS n_chars")
    corpus_pipeline.best_fit_packing(own, docs, "")

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    found = [r.n for r in docs.mapInPandas(sizes, "n long").collect()]
    assert sum(found) == 3000 and max(found) < 1000
