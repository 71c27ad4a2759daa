"""Operator 11: packing into windows by best-fit decreasing, over a segment tree of remaining capacities.

Documents become ids with an end id. One longer than a window is first cut into full windows; what is left of it, and every
shorter document, is a whole piece. Pieces are dealt by hash to shards of about SHARD_PIECES, and each shard is packed by itself
in descending order of length: a segment tree, whose leaves count the open windows of each remaining capacity, finds the
tightest window that takes a piece, and a new one is opened where none does.

A window is padded to its full length unless its length is a power of two. So the windows that stay open by more than SLACK ids are
closed: their pieces are laid end to end and cut again into full windows and, at the end, into windows of powers of two. That cuts
about one piece for each window so closed; no other document that fits a window is cut, and no window has more than SLACK ids of padding.

A null text is empty and makes a piece of the end id alone, repeated rows are packed as separate documents with the same
doc_id, a null doc_id is kept, pieces of equal length go in order of their hash, an empty table gives an empty result, a
text of any length is cut whole, other columns are not read.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, NUMBERS, UNUSUAL, kept, materialise, table, text_batches, tokenizer

CAPACITY = 2048
END_ID = 1
SHARD_PIECES = 50_000
#: Ids of padding that a window may keep.
SLACK = 16
#: The tokenizer's own split of a lower-case text of usual characters; white space is dropped.
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: A letter whose small form has two characters.
LONGER = "\u0130"


class WordEncoder:
    """Ids of whole texts as little-endian uint32 bytes, memoised by piece (letters, a digit, signs).

    New pieces are encoded many at a time, as one text with spaces between: each ends with the only token of it that ends a
    word. Texts with unusual characters are encoded in one go instead.
    """

    def __init__(self, path: str, memo: int = 700_000):
        self.tok, self.memo, self.ids = tokenizer(path), memo, {}
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a piece
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 20_000):
            some = pieces[i : i + 20_000]
            flat = self.whole([" ".join(some)])[0]
            ends = (4 * (np.flatnonzero(self.ends[np.frombuffer(flat, "<u4")]) + 1)).tolist()
            start = 0
            for piece, end in zip(some, ends, strict=True):
                self.ids[piece] = flat[start:end]
                start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        unusual = [UNUSUAL.search(text) is not None or LONGER in text for text in texts]
        odd = iter(self.whole([text for text, u in zip(texts, unusual) if u]))
        plain = [None if u else PIECE.findall(text.lower()) for text, u in zip(texts, unusual)]
        missing = set().union(*(pieces for pieces in plain if pieces)) - self.ids.keys()
        if len(self.ids) + len(missing) > self.memo:
            self.ids = {}
            missing = set().union(*(pieces for pieces in plain if pieces))
        self.learn(list(missing))
        get = self.ids.__getitem__
        return [next(odd) if pieces is None else b"".join(map(get, pieces)) for pieces in plain]


def word_encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("word encoder", path), lambda: WordEncoder(path))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: dict[int, list[int]] = {}

    def _count(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.counts[node] += change
            node >>= 1

    def add(self, window: int, room: int) -> None:
        self.windows.setdefault(room, []).append(window)
        self._count(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The open window of least room that takes size, taken out, and its room."""
        counts, node = self.counts, self.leaves + size
        while not counts[node]:
            while node & 1:  # a right child: what follows is above
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not counts[node]:
                node += 1
        room = node - self.leaves
        self._count(room, -1)
        return self.windows[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window and offset of each length, windows counting from 0, and the ids in each window."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = OpenWindows(capacity), []
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        number, room = tree.tightest(size) or (len(used), capacity)
        if number == len(used):
            used.append(0)
        window[i], offset[i] = number, used[number]
        used[number] += size
        if room > size:
            tree.add(number, room - size)
    return window, offset, np.array(used, np.int64)


def closed(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces laid end to end and cut into full windows, then windows of powers of two: (piece, start in it, length, window, offset)."""
    left, out, window, at = sum(sizes), [], 0, 0
    room = min(capacity, 1 << left.bit_length() - 1) if left else 0
    for piece, size in enumerate(sizes):
        start = 0
        while start < size:
            n = min(size - start, room - at)
            out.append((piece, start, n, window, at))
            start, at, left = start + n, at + n, left - n
            if at == room and left:
                window, at, room = window + 1, 0, min(capacity, 1 << left.bit_length() - 1)
    return out


def packed(lengths: np.ndarray, capacity: int = CAPACITY, slack: int = SLACK) -> list[np.ndarray]:
    """piece, start in it, length, window and offset of all parts that the pieces of a shard are packed as."""
    window, offset, used = best_fit_decreasing(lengths, capacity)
    loose = (capacity - used > slack) & (used & (used - 1) != 0)
    stay = np.flatnonzero(~loose[window])
    parts = [stay, np.zeros(len(stay), np.int64), lengths[stay], window[stay], offset[stay]]
    again = np.flatnonzero(loose[window])
    again = again[np.argsort(-lengths[again], kind="stable")]
    if not len(again):
        return parts
    more = np.array(closed(lengths[again].tolist(), capacity), np.int64).T
    return [np.concatenate(x) for x in zip(parts, (again[more[0]], more[1], more[2], more[3] + len(used), more[4]))]


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """uid (unique in one run), doc_id, start, length, ids_crc32, doc_tokens and ids (little-endian uint32) of full windows and of what is left of each document."""
    import zlib

    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches):
        encode, uid = word_encoder(tokenizer_path).encode, TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in text_batches(batch, "text"):
                rows = []
                for doc_id, ids in zip(some["doc_id"].tolist(), encode(some["text"].tolist())):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        own = ids[4 * start : 4 * (start + capacity)]
                        rows.append((uid, None if pd.isna(doc_id) else int(doc_id), start, len(own) // 4, zlib.crc32(own), n, own))
                        uid += 1
                yield pd.DataFrame(rows, columns=["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]).astype({"doc_id": "Int64"})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInPandas(pieces, "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack_windows(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK, shard_pieces: int = SHARD_PIECES, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, ids of each piece of docs(doc_id, text).

    The pieces are written once. Only uids and lengths meet by shard; ids are read again for the pieces that closing cuts, or with keep_ids.
    """
    pieces = materialise(tokenised(docs, tokenizer_path, capacity, end_id), "windows")
    shards = max(1, -(-pieces.count() // shard_pieces))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        piece, at, n, window, offset = packed(lengths, capacity, slack)
        return pd.DataFrame({"uid": pdf["uid"].to_numpy()[piece], "at": at, "part": n, "whole": n == lengths[piece], "sequence_id": window + (int(key[0]) << 40), "offset": offset})

    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(11)), F.lit(shards)).alias("shard"))
    placed = materialise(dealt.groupBy("shard").applyInPandas(pack, "uid long, at long, part long, whole boolean, sequence_id long, offset long"), "places")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    own = F.substring("ids", (4 * F.col("at") + 1).cast("int"), (4 * F.col("part")).cast("int"))
    if keep_ids:
        return pieces.join(placed, "uid").withColumn("ids", own).select("doc_id", (F.col("start") + F.col("at")).alias("start"), F.col("part").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
    uncut = pieces.drop("ids").join(placed.where("whole"), "uid").select(*out)
    cut = materialise(placed.where("NOT whole").drop("whole"), "cuts")  # few, so that the ids needn't be shuffled for them
    parts = pieces.select("uid", "doc_id", "start", "doc_tokens", "ids").join(cut, "uid")
    parts = parts.select("doc_id", (F.col("start") + F.col("at")).alias("start"), F.col("part").alias("length"), F.crc32(own).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return uncut.unionByName(parts)


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_windows(docs, word_bpe_path(), keep_ids=False)
