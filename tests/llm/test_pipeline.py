"""The pipeline's stages against brute force, each on its own input."""

import zlib
from collections import Counter

import corpus_pipeline as cp
import numpy as np
from tarnweave.llm import common, packing, toxicity
from tarnweave.llm.common import materialise


def grams(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(texts):
    """Smallest index linked to each text, by all pairs."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    for _ in range(len(texts)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = materialise(stage(spark, docs, data), name)
        assert docs.columns == cp.COLUMNS
        kept[name] = before.toPandas(), docs.toPandas()
    before, after = kept["language_id"]
    assert set(before.doc_id) - set(after.doc_id) <= set(before[~before.text.fillna("").str.contains(r"[^\W\d_]", regex=True)].doc_id)
    before, after = kept["toxicity"]
    model = toxicity.fit_on(spark.createDataFrame(before[["doc_id", "text"]]), spark.read.parquet(f"{data}/labels.parquet"))
    assert set(after.doc_id) == {i for i, s in zip(before.doc_id, toxicity.scores(before.text.fillna("").tolist(), model)) if s < 0.7}
    before, after = kept["simhash_dedup"]  # five-word shingles, similarity 0.8
    before = before.sort_values("doc_id")
    root = components(before.text.tolist())
    assert sorted(after.doc_id) == sorted(i for k, i in enumerate(before.doc_id) if root[k] == k)
    before, after = kept["source_mixing"]
    assert set(after.doc_id) <= set(before.doc_id) and 0.5 < after.text.str.len().sum() / before.text.str.len().sum() < 1.5
    packed = cp.STAGES[-1][1](spark, docs, data).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    assert (packed.piece == 0).sum() == len(after)
    end = np.array([packing.END_ID], "<u4").tobytes()
    tok = common.tokenizer(common.byte_bpe_path())
    ids = lambda text: np.asarray(tok.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes() + end
    given = Counter((r.doc_id, ids(r.text)) for r in after.itertuples())
    assert Counter((r.doc_id, r.ids[:4]) for r in packed.itertuples() if r.piece == 0) == Counter((k, x[:4]) for (k, x), n in given.items() for _ in range(n))
    assert sum(map(len, packed.ids)) == sum(len(x) * n for (_, x), n in given.items()) and all(zlib.crc32(r.ids) == r.ids_crc32 for r in packed.itertuples())
    whole = {k: x for k, x in given}
    assert all(whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)] == r.ids for r in packed.itertuples())


def test_stages_do_not_depend_on_partitions(spark, data):
    """The same rows stay however the files are read."""
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(7)
    many = materialise(docs, "many")
    found, key = [], "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("128m", "64k"):
            spark.conf.set(key, size)
            rows = cp._numbered(many, "t") if size == "128m" else cp._numbered(many.repartition(5), "t")
            assert rows.select("row_no").distinct().count() == many.count()
            spark.conf.set(key, "128m" if size == "64k" else "64k")  # read otherwise than written
            kept = rows.where("doc_id % 3 = 0").select("row_no")
            found.append(sorted(r.doc_id for r in cp._only(rows, kept).collect()))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] and all(i % 3 == 0 for i in found[0])


def test_pipeline_without_rows(spark, data):
    docs = materialise(spark.read.parquet(f"{data}/documents.parquet").where("false"), "none")
    for name, stage in cp.STAGES:
        docs = materialise(stage(spark, docs, data), name)
        assert docs.count() == 0


def test_repeated_ids_leave_one(spark, data):
    rows = [(1, "the same text", "en", "s", 13), (1, "the same text", "en", "s", 13), (None, "the same text", "en", "s", 13), (2, None, None, None, None)]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "rows")
    assert sorted(r.doc_id for r in cp.simhash_dedup(spark, docs, data).collect()) == [1, 2]
