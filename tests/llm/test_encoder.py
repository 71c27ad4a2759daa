"""The byte-level encoder against the library, and what it asks of its memo and of the library."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tarnweave.llm import common, packing

PARTS = "' 's 'll 'l 're 've 'd 'm 't r e v l s a Zé ß 12 ³ ½ ! ... — € ‘ < |".split(" ") + [" ", "  ", "\n", "\t", "\r", "\xa0"]
ODD = ["\0", "中", "😀", "<|", "<|endoftext|>", "\x1c", " ", "\x85", "é"]


def ids_of(texts):
    return [np.asarray(e.ids, "<u4").tobytes() for e in common.tokenizer(common.byte_bpe_path()).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("memo", [5, 50, 1_000_000])
def test_random_texts(memo):
    draw, encoder = random.Random(memo), common.Encoder(common.byte_bpe_path(), memo)
    assert encoder.encode([]) == [] and encoder.encode(["", ""]) == [b"", b""]
    for _ in range(100):
        parts = PARTS + ODD * (draw.random() < 0.2)
        texts = ["".join(draw.choices(parts, k=draw.randrange(40))) for _ in range(draw.randrange(20))]
        assert encoder.encode(texts) == ids_of(texts)


@pytest.fixture
def asked():
    """A kind of dict and the keys it was asked for."""
    keys = []

    class Memo(dict):
        def get(self, key):
            keys.append(key)
            return dict.get(self, key)

        def __getitem__(self, key):
            keys.append(key)
            return dict.__getitem__(self, key)

    return Memo, keys


def test_memo_is_asked_once_for_each_different_piece(asked):
    memo, keys = asked
    encoder = common.Encoder(common.byte_bpe_path())
    encoder.encode(["the cat"])
    encoder.ids = memo(encoder.ids)
    texts = ["the cat" * 1000, "the cat the cat"]
    assert encoder.encode(texts) == ids_of(texts) and len(keys) < 10


def test_packing_asks_the_memo_once_for_each_different_piece(spark, asked, monkeypatch):
    memo, keys = asked
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, function, schema: function)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    encoder = common.encoder(common.byte_bpe_path())
    encoder.ids = memo(encoder.ids)
    text = "the cat sat on 12 mats. " * 2000
    found = pd.concat(packing.tokenised_pieces(docs, common.byte_bpe_path())(iter([pd.DataFrame({"doc_id": [1, 2], "text": [text, ""]})])))
    common.give_back()
    ids = ids_of([text])[0] + b"\0\0\0\0"
    assert b"".join(found["ids"]) == ids + b"\0\0\0\0" and found["doc_id"].tolist() == [1] * (len(found) - 1) + [2]
    assert found["length"].max() == packing.CAPACITY and len(keys) < 30


def test_full_memo_keeps_what_the_batch_has_in_common():
    encoder, given = common.Encoder(common.byte_bpe_path(), memo=4), []

    class Library:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.tok.encode_batch_fast(texts, **options)

    encoder.encode(["the cat sat"])
    encoder.tok = Library(encoder.tok)
    assert encoder.encode(["the cat ran 12"]) == ids_of(["the cat ran 12"])
    assert "ran" in "".join(given) and "cat" not in "".join(given)


def test_numbers_and_signs_are_learned_together():
    encoder, calls = common.Encoder(common.byte_bpe_path()), []
    whole = encoder.whole
    encoder.whole = lambda texts: calls.extend(texts) or whole(texts)
    texts = [" ".join(f"{i} !{'?' * i}" for i in range(100))]
    assert encoder.encode(texts) == ids_of(texts) and len(calls) < 10
