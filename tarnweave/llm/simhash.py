"""Operator 4: SimHash near-duplicates by meet-in-the-middle ball hashing.

Words of the lower-cased text form shingles; each bit of the fingerprint is the majority over the shingles'
XXH64 hashes. Every distinct fingerprint emits all variants within half the radius (for radius 2: itself and
its 64 one-bit neighbours); two fingerprints within the radius always share a variant, and a variant has at
most 65 owners, so no bucket can grow with a group of copies. Owners of a variant are paired with its
smallest owner, pairs are deduplicated and verified by their differing bits, and linked fingerprints form
components.

A null text is empty; texts without words have fingerprint zero and link like any other; repeated rows are
rows of their own with one fingerprint; null doc_ids are kept and never name a component while another does;
an empty table gives an empty result; other columns pass through where the docstring says so.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, shuffle_partitions, table, text_batches

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
BITS = 64
#: Bits of each byte value, least significant first.
OCTETS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; empty without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, white space 09-0D and 20
    if not parts:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """Unsigned: bits that are set in over half the hashes; 0 for none."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.array([np.bincount(octets[:, i], minlength=256) for i in range(8)])
    bits = (counts @ OCTETS).reshape(-1) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def simhash(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of one text, unsigned."""
    return majority_bits(shingle_hashes(text, words, seed))


def with_fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep (a column fp among them is replaced) and fp (the fingerprint's 64 bits as a signed long); the text itself does not travel on."""
    keep = tuple(c for c in keep if c != "fp")
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def prints(batches):
        for batch in batches:
            for some in text_batches(batch, "__text"):
                values = np.array([simhash(t) for t in some["__text"].tolist()], np.uint64).view(np.int64)
                yield some.drop(columns="__text").assign(fp=values)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "fp long"])
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInPandas(prints, schema)


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, among distinct fingerprints fps(fp) that keep every group within `radius` bits connected. Variants of one bit serve a radius of 1 or 2."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
    # few bytes become many rows: dealt out first, so that no task explodes a whole file of fingerprints
    variants = fps.repartition(shuffle_partitions(fps.sparkSession), "fp").select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    owners = variants.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    pairs = owners.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicate_classes(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """prints(key, fp, ...) with component_id: the smallest key reachable by links of at most `radius` bits.

    prints is read three times and should be a table.
    """
    distinct = materialise(prints.groupBy("fp").agg(F.min(key).alias("least")), "prints")
    parts = connected_components(ball_links(distinct.select("fp"), radius))
    labelled = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    # one row for each distinct fingerprint; a hot fingerprint is hot on the documents' side only, where AQE may split it
    named = materialise(labelled.join(least, "component").select("fp", "component_id"), "components")
    return prints.join(named, "fp")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialise(with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "simhash")
    return near_duplicate_classes(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
