"""Operator 12: hard negatives by a two-dimensional block matrix product.

Scores are integer inner products. Rows are dealt to blocks of about ROW_BLOCK (anchors: ANCHOR_BLOCK), and each block's
components to chunks of dimensions. A block of anchors meets a block of rows once for each chunk, which gives a partial int64
tile of scores; the partial tiles of a pair of blocks are shuffled together and added; the sum is reduced to each anchor's best
rows in it, and the best of all tiles are taken by a window over these. Two such products are made: anchors against the rows of their
own label (blocks lie within a label), for the positives, and anchors against all rows, for the negatives, in which the tiles keep the
first rows of another label inside each positive's window of scores. No tile outgrows ANCHOR_BLOCK x ROW_BLOCK, and no task sees more
than a pair's CHUNKS tiles.

Rows with a null key or label, a null vector, or null or non-finite components take no part. An empty vector scores 0 with all;
where vectors differ in length, missing components count as 0. Ties go by key, then by row; repeated rows, and rows with one key, are rows of their own (a
row is never its own positive, its copy may be). Scores are 64-bit integers and wrap round beyond (not below 2**26 a component and
2048 of them). An anchor without positives or fitting negatives has no rows in the result; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

ANCHOR_BLOCK, ROW_BLOCK = 256, 2048
#: Dimensions of a chunk at least, and chunks of a vector at most.
CHUNK, CHUNKS = 32, 8
POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
NONE = np.iinfo(np.int64).min
BLOCK = "uids binary, keys binary, labels binary, near binary, width int, body binary"


def _blocks(rows: DataFrame, group: Column, shards: Column, partners: Column, chunk: int, near: Column) -> DataFrame:
    """Packed blocks: grp, shard, partners, chunk, and BLOCK; rows: uid, key, label, vector and what the columns need."""
    vector = F.col("vector")
    n_chunks = F.greatest(F.ceil(F.size(vector) / chunk), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda c: F.slice(vector, c * chunk + 1, chunk))
    dealt = rows.select(group.alias("grp"), F.pmod(F.xxhash64("uid", F.lit(12)), shards).alias("shard"), partners.alias("partners"), "uid", "key", "label", near.alias("near"), F.posexplode(parts).alias("chunk", "part"))
    dealt = dealt.withColumn("near", F.when(F.col("chunk") == 0, F.col("near")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "uid"])  # the order of ties, the same in every chunk
        sizes = pdf["part"].map(len)
        body = np.zeros((len(pdf), int(sizes.max())), np.int64)
        if sizes.min() == sizes.max():
            body[:] = np.stack(pdf["part"].to_numpy())
        else:
            for at, part in enumerate(pdf["part"]):
                body[at, : len(part)] = part
        first = pdf.iloc[0]
        near = b""
        if first["chunk"] == 0 and first["near"] is not None:
            filled = np.full((len(pdf), POSITIVES_MOST), NONE, np.int64)
            for at, scores in enumerate(pdf["near"]):
                filled[at, : len(scores)] = scores
            near = filled.tobytes()
        packed = [pdf[c].to_numpy(np.int64).tobytes() for c in ("uid", "key", "label")]
        return pd.DataFrame([[first["grp"], first["shard"], first["partners"], first["chunk"], *packed, near, body.shape[1], body.tobytes()]], columns=["grp", "shard", "partners", "chunk", "uids", "keys", "labels", "near", "width", "body"])

    return dealt.groupBy("grp", "shard", "partners", "chunk").applyInPandas(pack, f"grp long, shard long, partners long, chunk int, {BLOCK}")


#: Width of the table of positives' scores that travels with a block of anchors.
POSITIVES_MOST = 64


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in 64-bit integers; by floating point where no sum can leave its exact range."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width and float(np.abs(a).max()) * float(np.abs(b).max()) * width < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Partial tiles of each pair of blocks of one grp, one for each chunk: grp, i, j, chunk, ids of both sides (whole in chunk 0), and the tile."""
    left = anchors.withColumnRenamed("shard", "i").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("partners") - 1)))
    right = rows.withColumnRenamed("shard", "j").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("partners") - 1)))
    on = ["grp", "i", "j", "chunk"]

    def multiply(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):  # the other side's vectors are shorter
            return pd.DataFrame(columns=[*on, "a_uids", "a_keys", "a_labels", "near", "b_uids", "b_keys", "b_labels", "tile"])
        a, b = a.iloc[0], b.iloc[0]
        tile = _product(_ints(a["body"]).reshape(len(a["uids"]) // 8, a["width"]), _ints(b["body"]).reshape(len(b["uids"]) // 8, b["width"]))
        return pd.DataFrame([[*key, a["uids"], a["keys"], a["labels"], a["near"], b["uids"], b["keys"], b["labels"], tile.tobytes()]], columns=[*on, "a_uids", "a_keys", "a_labels", "near", "b_uids", "b_keys", "b_labels", "tile"])

    schema = "grp long, i long, j long, chunk int, a_uids binary, a_keys binary, a_labels binary, near binary, b_uids binary, b_keys binary, b_labels binary, tile binary"
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(multiply, schema)


def _summed(pdf: pd.DataFrame):
    """The first chunk's row and the sum of a pair's partial tiles."""
    first = pdf[pdf["chunk"] == 0].iloc[0]
    a, b = _ints(first["a_uids"]), _ints(first["b_uids"])
    total = np.zeros((len(a), len(b)), np.int64)
    for part in pdf.itertuples():
        own_a, own_b = _ints(part.a_uids), _ints(part.b_uids)
        tile = _ints(part.tile).reshape(len(own_a), len(own_b))
        if len(own_a) == len(a) and len(own_b) == len(b):
            total += tile
        else:  # shorter vectors have no such chunk; the order is the same
            total[np.ix_(np.flatnonzero(np.isin(a, own_a)), np.flatnonzero(np.isin(b, own_b)))] += tile
    return first, total


def _best_positives(most: int):
    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        first, scores = _summed(pdf)
        a, b, keys = _ints(first["a_uids"]), _ints(first["b_uids"]), _ints(first["b_keys"])
        out = []
        for at, row in enumerate(scores):
            order = np.argsort(-row, kind="stable")[: most + 1]
            order = order[b[order] != a[at]][:most]
            out.append(pd.DataFrame({"uid": a[at], "positive_id": keys[order], "other": b[order], "positive_score": row[order]}))
        return pd.concat(out)

    return best


def _best_negatives(most: int, low: int, high: int):
    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        first, scores = _summed(pdf)
        a, b, keys = _ints(first["a_uids"]), _ints(first["b_uids"]), _ints(first["b_keys"])
        scores[_ints(first["a_labels"])[:, None] == _ints(first["b_labels"])[None, :]] = NONE
        near = _ints(first["near"]).reshape(len(a), POSITIVES_MOST)
        order = np.argsort(np.where(scores == NONE, np.iinfo(np.int64).max, -scores), axis=1, kind="stable")
        ranked = np.take_along_axis(scores, order, 1)
        found = []
        for slot in range(POSITIVES_MOST):
            positive = near[:, slot]
            known = np.flatnonzero(positive > NONE)
            if not len(known):
                break
            least, greatest = -((-low * positive[known]) // 100), (high * positive[known]) // 100
            start = (ranked[known] > greatest[:, None]).sum(1)
            for k in range(most):
                place = start + k
                inside = np.flatnonzero(place < len(b))
                inside = inside[(ranked[known[inside], place[inside]] >= least[inside]) & (ranked[known[inside], place[inside]] > NONE)]
                if not len(inside):
                    break
                who = order[known[inside], place[inside]]
                found.append(pd.DataFrame({"uid": a[known[inside]], "slot": slot, "negative_id": keys[who], "other": b[who], "negative_score": scores[known[inside], who]}))
        return pd.concat(found) if found else pd.DataFrame(columns=["uid", "slot", "negative_id", "other", "negative_score"])

    return best


def hard_negatives(rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: key and label long, vector array<long>, nulls taking no part; is_anchor: a condition over key."""
    if not 0 < positives <= POSITIVES_MOST:
        raise ValueError(f"positives must be 1 to {POSITIVES_MOST}")
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    own = own.where(F.col("key").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))
    own = materialise(own.withColumn("uid", F.monotonically_increasing_id()), "negative-rows")
    n_rows, n_anchors, dim = own.agg(F.count("*"), F.count_if("is_anchor"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    chunk = max(CHUNK, -(-dim // CHUNKS))
    no_near = F.lit(None).cast("array<long>")

    # positives: blocks within a label
    blocks_of = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("long")
    sizes = own.groupBy("label").agg(blocks_of(F.count("*"), ROW_BLOCK).alias("row_blocks"), blocks_of(F.count_if("is_anchor"), ANCHOR_BLOCK).alias("anchor_blocks"))
    sized = own.join(sizes, "label")
    left = _blocks(sized.where("is_anchor"), F.col("label"), F.col("anchor_blocks"), F.col("row_blocks"), chunk, no_near)
    right = _blocks(sized, F.col("label"), F.col("row_blocks"), F.col("anchor_blocks"), chunk, no_near)
    found = _tiles(left, right).groupBy("grp", "i", "j").applyInPandas(_best_positives(positives), "uid long, positive_id long, other long, positive_score long")
    first = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id", "other")
    chosen = materialise(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives), "positives")

    # negatives: all rows in blocks, anchors with their positives' scores
    order = F.sort_array(F.collect_list(F.struct("place", "positive_score")))
    known = chosen.groupBy("uid").agg(F.transform(order, lambda x: x["positive_score"]).alias("near"))
    a_blocks, r_blocks = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    one = F.lit(0).cast("long")
    left = _blocks(own.where("is_anchor").join(known, "uid"), one, F.lit(a_blocks).cast("long"), F.lit(r_blocks).cast("long"), chunk, F.col("near"))
    right = _blocks(own, one, F.lit(r_blocks).cast("long"), F.lit(a_blocks).cast("long"), chunk, no_near)
    tiles = _tiles(left, right).groupBy("grp", "i", "j").applyInPandas(_best_negatives(negatives, low, high), "uid long, slot int, negative_id long, other long, negative_score long")
    best = Window.partitionBy("uid", "slot").orderBy(F.desc("negative_score"), "negative_id", "other")
    ranked = tiles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = chosen.select("uid", (F.col("place") - 1).alias("slot"), "positive_id", "positive_score").join(own.where("is_anchor").select("uid", F.col("key").alias("anchor_id")), "uid")
    return ranked.join(named, ["uid", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector (of integers) of embeddings whose vectors are whole; every seventh label is the next one."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    wide = F.col("embedding").cast("array<double>")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.where(F.coalesce(F.forall(wide, finite), F.lit(False))).select("vec_id", label.cast("long").alias("label"), F.transform(wide, lambda x: F.floor(F.lit(256.0) * x)).alias("vector"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; anchors are those whose vec_id is divisible by 100: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    return hard_negatives(quantised(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND n.label <> n.anchor_label AND {LOW} * positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
