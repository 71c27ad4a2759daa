"""Operator 2: token ids in bit-plane shuffled files.

A file is a stream of ids cut into blocks of BLOCK_IDS. A block's little-endian uint32 ids are transposed
into 4 byte planes (or 32 bit planes), each plane is compressed with zstandard by itself, and the chunk
index at the file's end holds for each block its place, its number of ids and the sizes of its planes, and
for each document its id and its number of ids:

    planes of block 0, 1, ... | index (zstandard) | u64 size of the index | MAGIC

Documents are dealt to files by ranges of doc_id and lie in ascending order of (doc_id, text). A task writes
its file under a name of its own and then moves it into place; the manifest, itself a Parquet table written
with Spark's commit, lists only files of tasks that succeeded, so a lost executor costs a repeated task.

A null text is empty and has the end id only, a null doc_id sorts first, repeated rows are separate
documents, an empty table gives no files and an empty result, other columns are not read.
"""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_bpe_path, encoder, filesystem, new_path, shuffle_partitions, table, text_batches

MAGIC = b"TWPLANE1"
BLOCK_IDS = 65_536
#: A task goes on to another file after so many ids (1 GiB before compression).
FILE_IDS = 268_435_456
#: And after so many documents, whose list lies in memory.
FILE_DOCS = 500_000
END_ID = 2
MANIFEST = "part int, file_no int, path string, n_docs long, n_ids long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes (4) or bit planes (32, each padded to whole bytes) of uint32 ids."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [plane.tobytes() for plane in octets.T]
    return [np.packbits(plane).tobytes() for plane in np.unpackbits(octets, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        octets = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes documents' ids to a binary stream in the file format above."""

    def __init__(self, out, bits: bool = False, level: int = 3):
        import zstandard

        self.out, self.bits, self.pack = out, bits, zstandard.ZstdCompressor(level=level)
        self.pending, self.waiting, self.at = [], 0, 0
        self.blocks, self.docs, self.n_ids = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id is not None, doc_id or 0, n))
        self.pending.append(ids)
        self.waiting += n
        self.n_ids += n
        if self.waiting >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        stream = b"".join(self.pending)
        size = 4 * BLOCK_IDS
        whole = len(stream) if all_of_it else len(stream) // size * size
        for i in range(0, whole, size):
            ids = np.frombuffer(stream[i : min(i + size, whole)], "<u4")
            planes = [self.pack.compress(p) for p in to_planes(ids, self.bits)]
            self.blocks.append([self.at, len(ids), *map(len, planes)])
            self.out.write(b"".join(planes))
            self.at += sum(map(len, planes))
        self.pending = [stream[whole:]]
        self.waiting = len(stream[whole:]) // 4

    def close(self) -> None:
        self._flush(True)
        head = struct.pack("<BQQ", self.bits, len(self.blocks), len(self.docs))
        docs = np.array(self.docs, "<i8").reshape(-1, 3)
        index = self.pack.compress(head + np.array(self.blocks, "<i8").tobytes() + docs.tobytes())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class PlaneReader:
    """Random and sequential access to a file of the format above; `data` is seekable and binary."""

    def __init__(self, data):
        import zstandard

        self.data, self.unpack = data, zstandard.ZstdDecompressor()
        end = data.seek(0, io.SEEK_END)
        data.seek(end - 16)
        tail = data.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<Q", tail[:8])[0]
        data.seek(end - 16 - size)
        index = self.unpack.decompress(data.read(size))
        bits, n_blocks, n_docs = struct.unpack_from("<BQQ", index)
        self.bits, width = bool(bits), 2 + (32 if bits else 4)
        self.blocks = np.frombuffer(index, "<i8", n_blocks * width, 17).reshape(-1, width)
        self.docs = np.frombuffer(index, "<i8", n_docs * 3, 17 + 8 * n_blocks * width).reshape(-1, 3)

    def block(self, i: int) -> np.ndarray:
        at, n, *sizes = self.blocks[i].tolist()
        self.data.seek(at)
        packed, planes = self.data.read(sum(sizes)), []
        for size in sizes:
            planes.append(self.unpack.decompress(packed[:size]))
            packed = packed[size:]
        return from_planes(planes, n, self.bits)

    def documents(self):
        """(doc_id or None, ids as bytes) in the order of the file; holds a block and a document at a time."""
        buffer, block = b"", 0
        at = 0
        for known, doc_id, n in self.docs.tolist():
            parts, need = [], 4 * n
            while need:
                if at == len(buffer):
                    buffer, at, block = self.block(block).tobytes(), 0, block + 1
                part = buffer[at : at + need]
                at += len(part)
                need -= len(part)
                parts.append(part)
            yield (doc_id if known else None), b"".join(parts)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, bits: bool = False) -> DataFrame:
    """Tokenise docs(doc_id, text) into files in folder; the manifest's rows (MANIFEST), from its Parquet table."""
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path).encode
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        rows, out, writer, temporary = [], None, None, ""

        def finish():
            writer.close()
            out.close()
            name = f"{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.ids"
            fs.move(temporary, f"{root}/{name}")
            rows.append((part, len(rows), f"{folder}/{name}", len(writer.docs), writer.n_ids))

        try:
            for batch in batches:
                for some in text_batches(batch, "text"):
                    for doc_id, ids in zip(some["doc_id"].tolist(), encode(some["text"].tolist())):
                        if writer is None:
                            temporary = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                            out = fs.open_output_stream(temporary)
                            writer = PlaneWriter(out, bits)
                        writer.add(None if pd.isna(doc_id) else int(doc_id), ids + end)
                        if writer.n_ids >= FILE_IDS or len(writer.docs) >= FILE_DOCS:
                            finish()
                            writer = None
            if writer is not None:
                finish()
                writer = None
        except BaseException:
            if writer is not None:  # the attempt that repeats this task writes its own file
                out.close()
                fs.delete_file(temporary)
            raise
        yield pd.DataFrame(rows, columns=["part", "file_no", "path", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, ids (binary) of every document; start counts the ids of all documents before it."""
    spark = manifest.sparkSession
    # one row for each file; files hold up to FILE_IDS ids
    before = W.orderBy("part", "file_no").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches):
        for batch in batches:
            for path, start in zip(batch["path"], batch["base"].tolist()):
                fs, place = filesystem(path)
                with fs.open_input_file(place) as data:
                    rows, size = [], 0
                    for doc_id, ids in PlaneReader(data).documents():
                        rows.append((doc_id, start, ids))
                        start += len(ids) // 4
                        size += len(ids)
                        if size > 16_000_000:
                            yield _documents(rows)
                            rows, size = [], 0
                    if rows:
                        yield _documents(rows)

    return files.repartition(shuffle_partitions(spark), "path").mapInPandas(read, "doc_id long, start long, ids binary")


def _documents(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "ids"])
    return frame.astype({"doc_id": "Int64"})


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through token files and back: doc_id, start, n_tokens, ids_crc32."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = read_token_files(write_token_files(docs, new_path(spark, "tokens"), byte_bpe_path()))

    # the checksum is taken from the ids as read back
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
