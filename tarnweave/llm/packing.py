"""Operator 5: best-fit packing by large-item matching.

Documents become ids with an end id; one longer than a sequence is cut into full pieces, of which only the
first may be shorter. Pieces are dealt by hash to shards of about SHARD_PIECES, and each shard is packed by
itself: pieces above a third of the capacity go at most two to a sequence, each in descending order with
the largest other that fits (greedy matching); the smaller ones, in descending order, go to the smallest gap
that takes them, and open new sequences where none does. A shard leaves a few sequences part empty, a share
that is fixed by SHARD_PIECES and does not grow with the corpus.

A null text is empty and makes a piece of the end id alone, repeated rows are packed as separate documents
with the same doc_id, a null doc_id is kept, an empty table gives an empty result, other columns are unread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_bpe_path, encoder, materialise, table, text_batches

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 50_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """uid (unique in one run), doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids (little-endian uint32) of each piece."""
    import zlib

    from pyspark import TaskContext

    end = np.array([end_id], "<u4").tobytes()
    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def pieces(batches):
        encode, uid = encoder(tokenizer_path).encode, TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in text_batches(batch, "text"):
                rows = []
                for doc_id, ids in zip(some["doc_id"].tolist(), encode(some["text"].tolist())):
                    ids += end
                    for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((uid, None if pd.isna(doc_id) else int(doc_id), i, start, length, zlib.crc32(own)) + ((own,) if keep_ids else ()))
                        uid += 1
                yield pd.DataFrame(rows, columns=["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 + keep_ids]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(pieces, schema)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length; sequences count from 0."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    n_large = int((lengths * 3 > capacity).sum())
    waiting: dict[int, list[int]] = {}
    for i in reversed(order[:n_large]):
        waiting.setdefault(sizes[i], []).append(i)
    held = sum(1 << size for size in waiting)  # bit s: a large piece of length s waits
    gaps: dict[int, list[int]] = {}
    room = 0  # bit g: a sequence with gap g is open
    n_sequences = 0

    def take(size: int) -> int:
        nonlocal held
        i = waiting[size].pop()
        if not waiting[size]:
            held ^= 1 << size
            del waiting[size]
        return i

    def leave(number: int, gap: int) -> None:
        nonlocal room
        if gap:
            gaps.setdefault(gap, []).append(number)
            room |= 1 << gap

    while held:
        i = take(held.bit_length() - 1)
        sequence[i], gap = n_sequences, capacity - sizes[i]
        fitting = held & ((1 << (gap + 1)) - 1)
        if fitting:
            j = take(fitting.bit_length() - 1)
            sequence[j], offset[j] = n_sequences, sizes[i]
            gap -= sizes[j]
        leave(n_sequences, gap)
        n_sequences += 1
    for i in order[n_large:]:
        size = sizes[i]
        fitting = room >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                room ^= 1 << gap
        else:
            number, gap = n_sequences, capacity
            n_sequences += 1
        sequence[i], offset[i] = number, capacity - gap
        leave(number, gap - size)
    return sequence, offset


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces with sequence_id and offset; pieces has a long `uid` of its own and a length of 1 to capacity in each row, and any other columns.

    pieces is read up to three times (counted, dealt out, joined), so it should be a table, not a costly plan. Only uids
    and lengths meet by shard.
    """
    shards = max(1, -(-pieces.count() // shard_pieces))

    def pack(key, pdf):
        number, offset = pack_lengths(pdf["length"].to_numpy(), capacity)
        return pdf[["uid"]].assign(sequence_id=number + (int(key[0]) << 40), offset=offset)

    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(shards)).alias("__shard"))
    placed = dealt.groupBy("__shard").applyInPandas(pack, "uid long, sequence_id long, offset long")
    rest = [F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]
    return pieces.select(*rest).join(placed, "uid")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Packed pieces of docs(doc_id, text): tokenised_pieces' columns, sequence_id, offset."""
    return pack_pieces(materialise(tokenised_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces"), capacity).drop("uid")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, byte_bpe_path(), keep_ids=False)
