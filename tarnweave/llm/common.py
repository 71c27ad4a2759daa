"""What the operators of this subpackage share: tables, the shared folder, materialisation, components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where unset, in local runs only, one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tarnweave-shared")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tarnweave-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor takes nothing along."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bitmaps of 4 KB, each of 32 768 row numbers, that are broadcast at most: 32 MB, or 268 million rows numbered without gaps.
MOST_BITMAPS = 8192


def only_rows(rows: DataFrame, kept: DataFrame, key: str = "row_no", most: int = MOST_BITMAPS) -> DataFrame:
    """The rows whose key, a long, is in kept(key), a table.

    Row numbers that lie close together are broadcast as bitmaps, a bit for each row, so that the rows themselves aren't shuffled;
    those that need more than `most` bitmaps are joined.
    """
    bucket, place = F.bitmap_bucket_number(F.col(key)), F.bitmap_bit_position(F.col(key))
    if kept.select(bucket).distinct().count() > most:
        return rows.join(kept, key, "left_semi")
    bitmaps = materialise(kept.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(place).alias("__bits")), "bitmaps")
    octet = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = octet.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0
    return rows.withColumn("__bucket", bucket).join(F.broadcast(bitmaps), "__bucket").where(held).select(*[F.col(f"`{c}`") for c in rows.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """pyarrow file system and path inside it, for use in tasks; a path without scheme is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# The letters and numbers among the usual characters below.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts with other characters, or with what may be a special token, are encoded whole.
UNUSUAL = re.compile("<\\||[^\\t\\n\\r\\x20-\\x7e\\xa0-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]")


#: Kinds of UTF-16 units; an unusual one, and the zero that ends a text, has none.
NONE, SPACE, LETTER, NUMBER, SIGN = range(5)


@lru_cache(maxsize=1)
def unit_kinds():
    """The kind of each UTF-16 unit as an array of uint8."""
    import numpy as np

    found = np.zeros(1 << 16, np.uint8)
    for i in range(0x2100):  # usual characters end before
        if not UNUSUAL.match(c := chr(i)):
            found[i] = SPACE if c.isspace() else LETTER if re.match(f"[{LETTERS}]", c) else NUMBER if re.match(f"[{NUMBERS}]", c) else SIGN
    return found


def piece_starts(units, kinds):
    """Where the pieces start into which the byte-level tokenizer splits texts of usual characters, each ended by a zero, itself a piece:

    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?signs|\\s+(?!\\S)|\\s+
    """
    import numpy as np

    start = np.empty(len(units), bool)
    start[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start |= kinds == NONE
    # the last white space before other characters leaves its run; a blank joins what follows
    last = (kinds[:-1] == SPACE) & (kinds[1:] > SPACE)
    start[:-1] |= last
    start[1:] &= ~(last & (units[:-1] == ord(" ")))
    marks = np.flatnonzero((units == ord("'")) & start)
    padded = np.append(units, np.zeros(2, units.dtype))
    one, two = padded[marks + 1], padded[marks + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for some, size in ((marks[short], 2), (marks[long], 3)):
        start[some + 1] = False
        start[some + size] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, memoised by piece.

    Texts are split by arrays of their UTF-16 units and Arrow finds the different pieces of a batch, so that the memo is asked once for each
    of these. New pieces are encoded many at a time as one text, whose ids fall to its pieces by the lengths of their bytes. Texts with
    unusual characters are encoded in one go instead.
    """

    def __init__(self, path: str, memo: int = 700_000):
        import numpy as np

        self.tok, self.memo, self.ids = tokenizer(path), memo, {b"\0\0": b""}
        # a byte-level token's text has one character for each of its bytes
        sizes = {i: len(token) for token, i in self.tok.get_vocab(with_added_tokens=False).items()}
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)])

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[str], separator: str) -> list[bytes]:
        """The ids of words that stay pieces of their own in separator.join(words); separator is '' or a piece of one byte."""
        import numpy as np

        ends = np.cumsum([len(w.encode()) + len(separator) for w in words])
        flat = self.whole([separator.join(words)])[0]
        at = np.searchsorted(np.cumsum(self.sizes[np.frombuffer(flat, "<u4")]), ends - len(separator), side="left") + 1
        found, start, gap = [], 0, 4 * len(separator)
        for end in (4 * at).tolist():
            found.append(flat[start:end])
            start = end + gap
        return found

    def learn(self, pieces: list[bytes]) -> None:
        """Take new pieces (UTF-16) into the memo."""
        spaced, bare, blank = ([], []), ([], []), ([], [])
        for piece, word in zip(pieces, b"\0\0".join(pieces).decode("utf-16-le").split("\0")):
            keys, words = blank if word.isspace() else spaced if word[0] == " " else bare
            keys.append(piece)
            words.append(word)
        for (keys, words), separator in ((spaced, ""), (bare, "\n")):
            for i in range(0, len(words), 20_000):
                self.ids.update(zip(keys[i : i + 20_000], self.together(words[i : i + 20_000], separator)))
        self.ids.update(zip(blank[0], self.whole(blank[1])))

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa

        joined = "\0".join([*texts, ""])
        units = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        kinds = unit_kinds()[units]
        if "<|" in joined or np.count_nonzero(kinds == NONE) != len(texts):
            unusual = [UNUSUAL.search(text) is not None for text in texts]
            odd = iter(self.whole([text for text, u in zip(texts, unusual) if u]))
            plain = iter(self.encode([text for text, u in zip(texts, unusual) if not u]))
            return [next(odd if u else plain) for u in unusual]
        if not texts:
            return []
        starts = piece_starts(units, kinds)
        places = 2 * np.append(starts, len(units))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(units)]).dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.ids.get, different))
        if missing := [i for i, known in enumerate(ids) if known is None]:
            if len(self.ids) + len(missing) > self.memo:  # what this batch has in common with earlier ones is kept
                self.ids = {piece: known for piece, known in zip(different, ids) if known is not None}
            self.learn([different[i] for i in missing])
            for i in missing:
                ids[i] = self.ids[different[i]]
        # the ids of all pieces, gathered from those of the different ones
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.array(list(map(len, ids))) // 4
        of = pieces.indices.to_numpy()
        lengths = sizes[of]
        ends = np.cumsum(lengths)
        found = flat[np.repeat((np.cumsum(sizes) - sizes)[of] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[kinds[starts] == NONE]).tolist()
        return [found[start:end] for start, end in zip([0, *cuts], cuts)]


_kept: list = [None, None]


def kept(key, make):
    """make() or, where this worker's last call had the same key, its result: memos outlive tasks, but one at a time."""
    if _kept[0] != key:
        _kept[:] = [key, None]
        _kept[1] = make()
    return _kept[1]


def give_back(memo: bool = True) -> None:
    """Hand this worker's unused memory back to the system and, with `memo`, what kept() holds: workers outlive their tasks and share
    an executor's memory with stages that have no use for it."""
    import pyarrow as pa

    if memo:
        _kept[:] = [None, None]
    gc.collect()
    pa.default_memory_pool().release_unused()
    # long strings lay on malloc's heap, of which only the top is returned unasked; other systems than glibc's have no such call
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def encoder(path: str) -> Encoder:
    """One encoder for a Python worker, so its memo serves all tasks that the worker runs."""
    return kept(("encoder", path), lambda: Encoder(path))


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_batches(pdf, column: str, most: int = 2_000_000):
    """Slices of a pandas frame of about `most` characters of text each, for bounded memory."""
    start = size = 0
    for i, n in enumerate(pdf[column].str.len().fillna(0).astype(int).tolist()):
        if size and size + n > most:
            yield pdf.iloc[start:i]
            start, size = i, 0
        size += n
    if start < len(pdf):
        yield pdf.iloc[start:]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of edges(a, b); component is the smallest node reachable.

    Alternating large-star and small-star contraction on DataFrames, each round checkpointed in the
    shared folder. Only minima are aggregated, so a hub's neighbours are never gathered in one task.
    Empty edges give an empty result; self-links and repeated links are ignored.
    """
    shared_dir(edges.sparkSession)
    star = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()
    mark = None
    for _ in range(rounds):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        star = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        new = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
