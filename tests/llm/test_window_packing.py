"""Operator 11: every id against the tokenizer, every piece in its place, best fit against a plain search, and the edges."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnweave.llm import common, window_packing
from tarnweave.llm.queries import QUERIES

TOKENIZER = window_packing.word_bpe_path()
ODD = "aAéÉ'sStTrRlLdD12½.,!-<|>\x00\x01\x0b\x0c\x1c\x1f\x85 　​́İſßΣσς日ﬁǅ😀 \n\t"


def ids_of(texts):
    return [np.array([*e.ids, 1], "<u4") for e in common.tokenizer(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def padding(fill):
    return np.where(fill & (fill - 1) == 0, 0, 2048 - fill)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(ODD), max_size=30), max_size=5))
def test_ids_of_odd_texts(texts):
    texts = [*texts, "x<|endoftext|>y <|startoftext|>", "it's 'S we'LL"]
    assert window_packing.WordEncoder(TOKENIZER).encode(texts) == [ids[:-1].tobytes() for ids in ids_of(texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_tightest_window(sizes):
    window, offset, used = window_packing.best_fit_decreasing(np.array(sizes, np.int64), 64)
    rooms, plain = [], []
    for size in sorted(sizes, reverse=True):  # plain search; windows of equal room are alike
        fitting = [r for r in rooms if r >= size]
        room = min(fitting, default=64)
        if fitting:
            rooms.remove(room)
        rooms.append(room - size)
    assert sorted(64 - used) == sorted(rooms)
    for w in range(len(used)):
        own = np.flatnonzero(window == w)
        own = own[np.argsort(offset[own])]
        plain = np.array(sizes)[own]
        assert list(offset[own]) == list(np.cumsum(plain) - plain) and plain.sum() == used[w] <= 64


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(0, 8))
def test_parts(sizes, slack):
    piece, at, n, window, offset = window_packing.packed(np.array(sizes, np.int64), 64, slack)
    fill = np.bincount(window, n).astype(int)
    assert all(64 - f <= slack or f & (f - 1) == 0 for f in fill) and fill.max(initial=0) <= 64
    for k in range(len(sizes)):
        own = np.argsort(at[piece == k])
        starts, parts = at[piece == k][own], n[piece == k][own]
        assert list(starts) == list(np.cumsum(parts) - parts) and parts.sum() == sizes[k]
    for w in np.unique(window):
        own = np.argsort(offset[window == w])
        parts = n[window == w][own]
        assert list(offset[window == w][own]) == list(np.cumsum(parts) - parts)


def check(rows, texts):
    """rows: the query's; texts by doc_id."""
    own = dict(zip(texts, ids_of([t or "" for t in texts.values()])))
    for r in rows.itertuples():
        assert r.ids_crc32 == zlib.crc32(own[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(own[r.doc_id])
    for doc_id, pieces in rows.sort_values("start").groupby("doc_id"):
        assert list(pieces.start) == [0, *pieces.length.cumsum()[:-1]] and pieces.length.sum() == len(own[doc_id])
    for _, pieces in rows.sort_values("offset").groupby("sequence_id"):
        assert list(pieces.offset) == [0, *pieces.length.cumsum()[:-1]]
    fill = rows.groupby("sequence_id")["length"].sum().to_numpy()
    assert fill.max() <= 2048 and padding(fill).sum() <= 0.002 * fill.sum()


def test_query(spark, data):
    rows = QUERIES["op11_window_packing"](spark, data)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(rows.toPandas(), {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()})


def test_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 60_000, 4: "ß\x00 emoji 😀 <|endoftext|>\x1c x  y\n", 5: "a " * 2047, 6: "a " * 2048, 7: "b", 8: "c d"}
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in texts.items()], "doc_id long, text string, length string, sequence_id string")
    rows = window_packing.pack_windows(docs, TOKENIZER).toPandas()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows.itertuples())
    check(rows, texts)
    check(window_packing.pack_windows(docs, TOKENIZER, keep_ids=False, shard_pieces=5, slack=0).toPandas(), texts)
    repeated = docs.where("doc_id = 8").unionByName(docs.where("doc_id = 8")).unionByName(docs.where("doc_id = 7").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "length", "sequence_id"))
    assert sorted((r.doc_id or 0, r.length) for r in window_packing.pack_windows(repeated, TOKENIZER, keep_ids=False).collect()) == [(0, 2), (8, 3), (8, 3)]
    assert window_packing.pack_windows(docs.where("false"), TOKENIZER).count() == 0
