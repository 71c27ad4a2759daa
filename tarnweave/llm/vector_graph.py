"""Operator 8: near-duplicate vectors by hierarchical navigable small-world graphs.

Vectors of a label (and of one length) are dealt to shards of at most about SHARD_ROWS; each shard gets a
graph of its own, and every shard of the label is queried with every vector of the label, block by block. A
block's links are audited: AUDIT_ROWS at a time, its vectors are compared with the whole shard until AUDIT_LINKED
of them have links, and while less than AUDIT_RECALL of a vector's true links, in the mean of these, join vectors
that the search has joined, the beams are doubled; once a beam would be EXACT_SHARE of the shard, all its vectors are
compared instead. So they are where AUDIT_MOST vectors don't hold that many with links, as such a sample proves no
recall. The recall (null in a block whose vectors were all audited and have no links) is written beside the links. Equal
vectors are one node. Links are verified by cosine in double precision, united to components over all shards, and the
links of a node are then counted exactly inside its component, block against block, each node as often as it has vectors.

A null label, a null or empty vector, a zero vector, and one with null or non-finite components link with
nothing; repeated rows are rows of their own that link with each other; a null vec_id stays a row without
links whose component is null; ties need no rule, as no neighbour list decides a result; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, filesystem, materialise, new_path, table

THRESHOLD = 0.98
SHARD_ROWS = 16_384
#: Neighbours of a node (twice as many on the lowest layer), beam of building and first beam of searching.
NEIGHBOURS, BUILD_BEAM, BEAM = 12, 32, 24
#: Nodes of a layer for each node of the layer above.
LAYER_RATIO = 12
BATCH = 256
EXPAND = 4
AUDIT_ROWS, AUDIT_RECALL = 128, 0.99
#: Vectors with links that an audit is to see, and the most vectors it compares for that.
AUDIT_LINKED, AUDIT_MOST = 32, 2048
#: Share of a shard beyond which comparing everything is cheaper than a beam.
EXACT_SHARE = 0.25
#: Most tasks that search.
SEARCH_TASKS = 100_000
#: Nodes of a block in the exact count.
COUNT_ROWS = 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities (-1 and -inf where none) of the best found nodes, best first, for each query; entries: start nodes by query, -1 for none."""
    n, width = len(points), links.shape[1]
    beam = min(beam, n)
    ids, sims = np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), -np.inf, np.float32)
    rows, seen = np.arange(len(queries)), np.zeros((len(queries), n + 1), bool)
    seen[:, n] = True
    own_ids, own_sims, own_done, new = ids.copy(), sims.copy(), np.ones(ids.shape, bool), entries
    while len(rows):
        new = np.sort(np.where(new < 0, n, new), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        fresh = ~np.take_along_axis(seen, new, 1)
        np.put_along_axis(seen, new, True, 1)
        found = np.einsum("bd,bkd->bk", queries[rows], points[np.minimum(new, n - 1)])
        found[~fresh] = -np.inf
        own_ids, own_sims = np.concatenate([own_ids, new.astype(np.int32)], 1), np.concatenate([own_sims, found], 1)
        own_done = np.concatenate([own_done, ~fresh], 1)
        best = np.argpartition(-own_sims, beam - 1, axis=1)[:, :beam]
        own_ids, own_sims, own_done = (np.take_along_axis(x, best, 1) for x in (own_ids, own_sims, own_done))
        waiting = np.where(own_done, -np.inf, own_sims)
        k = min(EXPAND, beam)
        pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
        open_ = np.take_along_axis(waiting, pick, 1) > -np.inf
        np.put_along_axis(own_done, pick, True, 1)
        nodes = np.where(open_, np.take_along_axis(own_ids, pick, 1), -1)
        new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(rows), k * width)
        live = open_.any(1)
        if not live.all():
            ids[rows[~live]], sims[rows[~live]] = own_ids[~live], own_sims[~live]
            rows, seen, new = rows[live], seen[live], new[live]
            own_ids, own_sims, own_done = own_ids[live], own_sims[live], own_done[live]
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), ids, -1), sims


def diverse(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (best first, -1 for none), those nearer to the row's node than to any chosen before, filled up with the nearest others."""
    size = ids.shape[1]
    near = points[np.maximum(ids, 0)]
    between = np.einsum("bkd,bjd->bkj", near, near)
    chosen, n = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
    for k in range(size):
        blocked = (chosen[:, :k] & (between[:, k, :k] > sims[:, k : k + 1])).any(1) if k else np.zeros(len(ids), bool)
        chosen[:, k] = (ids[:, k] >= 0) & ~blocked & (n < most)
        n += chosen[:, k]
    rank = np.where(chosen, np.arange(size), np.where(ids >= 0, size + np.arange(size), 3 * size))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, 1) < 3 * size, np.take_along_axis(ids, order, 1), -1)


class Graph:
    """Layers of links over unit vectors; layer 0 has every node, each layer above a random part of the one below."""

    def __init__(self, points: np.ndarray, seed: int = 8):
        self.points, n = points, len(points)
        chance = np.random.default_rng(seed)
        height = np.floor(-np.log(1 - chance.random(n)) / np.log(LAYER_RATIO)).astype(int)
        order = chance.permutation(n)
        self.top = int(height.max(initial=0))
        self.entry = int(order[np.argmax(height[order] == self.top)]) if n else -1
        order = np.concatenate([[self.entry], order[order != self.entry]]).astype(int)
        self.links = [np.full((n, NEIGHBOURS * (1 + (level == 0))), -1, np.int32) for level in range(self.top + 1)]
        done = 1
        while done < n:
            batch = order[done : done + min(BATCH, done)]
            self._insert(batch, height[batch])
            done += len(batch)

    def _insert(self, batch: np.ndarray, height: np.ndarray) -> None:
        own = self.points[batch]
        entries = np.full((len(batch), 1), self.entry, np.int32)
        beside = own @ own.T
        np.fill_diagonal(beside, -np.inf)
        for level in range(self.top, -1, -1):
            ids, sims = beam_search(self.points, self.links[level], own, entries, BUILD_BEAM if level <= height.max() else 1)
            entries = ids[:, : min(4, ids.shape[1])]
            here = np.flatnonzero(height >= level)
            if not len(here):
                continue
            # the batch's own members aren't in the graph yet: the nearest join the candidates
            mates = np.where((height >= level)[None, :], beside[here], -np.inf)
            k = min(BUILD_BEAM // 2, len(batch))
            nearest = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            mate_sims = np.take_along_axis(mates, nearest, 1)
            all_ids = np.concatenate([ids[here], np.where(np.isfinite(mate_sims), batch[nearest], -1)], 1)
            all_sims = np.concatenate([sims[here], mate_sims.astype(np.float32)], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            chosen = diverse(self.points, np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1), NEIGHBOURS)
            self.links[level][batch[here], : chosen.shape[1]] = chosen
            self._link_back(level, batch[here], chosen)

    def _link_back(self, level: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        links = self.links[level]
        width = links.shape[1]
        targets, sources = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        targets, sources = targets[targets >= 0], sources[targets >= 0]
        similar = np.einsum("bd,bd->b", self.points[targets], self.points[sources])
        order = np.lexsort((-similar, targets))
        targets, sources = targets[order], sources[order]
        own, first, n = np.unique(targets, return_index=True, return_counts=True)
        place = np.arange(len(targets)) - np.repeat(first, n)
        near = place < 2 * width  # of one batch's links to the same node, the nearest
        added = np.full((len(own), min(2 * width, int(n.max(initial=1)))), -1, np.int32)
        added[np.repeat(np.arange(len(own)), n)[near], place[near]] = sources[near]
        ids = np.sort(np.concatenate([links[own], added], 1), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = np.where(ids >= 0, np.einsum("bd,bkd->bk", self.points[own], self.points[np.maximum(ids, 0)]), -np.inf)
        best = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        full = (ids >= 0).sum(1) > width
        kept = ids[:, :width].copy() if ids.shape[1] >= width else np.pad(ids, ((0, 0), (0, width - ids.shape[1])), constant_values=-1)
        if full.any():
            kept[full] = diverse(self.points, ids[full], sims[full], width)
        links[own] = kept

    def search(self, queries: np.ndarray, beam: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes of each query; known: nodes that the queries themselves are, if they are in the graph."""
        out = []
        for at in range(0, len(queries), BATCH):
            some = queries[at : at + BATCH]
            entries = np.full((len(some), 1), self.entry, np.int32)
            for level in range(self.top, 0, -1):
                entries = beam_search(self.points, self.links[level], some, entries, 4)[0]
            if known is not None:
                entries = np.concatenate([entries, known[at : at + BATCH, None].astype(np.int32)], 1)
            out.append(beam_search(self.points, self.links[0], some, entries, beam))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def verified(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (left[a], right[b]) of double vectors of length one have the cosine."""
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 65_536):
        some = slice(at, at + 65_536)
        keep[some] = np.einsum("bd,bd->b", left[a[some]], right[b[some]]) >= threshold
    return keep


def near_pairs(queries: np.ndarray, indexed: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with the cosine."""
    found = [(at + a, b) for at in range(0, len(queries), 512) for a, b in [np.nonzero(queries[at : at + 512] @ indexed.T >= threshold)]]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


def linked(graph: Graph, indexed: np.ndarray, queries: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, float | None]:
    """Root of each node (queries first, then indexed; of the same vectors if same), and the audit's recall, None where all queries were audited and none has links. Arguments of double precision and length one."""
    shift = 0 if same else len(queries)
    n = shift + len(indexed)
    order = np.random.default_rng(len(queries)).permutation(len(queries))
    parts, having, proven = [], 0, True
    for at in range(0, len(order), AUDIT_ROWS):  # on until enough vectors have links
        sample = order[at : at + AUDIT_ROWS]
        q, i = np.nonzero(queries[sample] @ indexed.T >= threshold)
        q = sample[q]
        if same:
            q, i = q[q != i], i[q != i]
        parts.append((q, i))
        having += len(np.unique(q))
        if having >= AUDIT_LINKED:
            break
        if AUDIT_MOST <= at + AUDIT_ROWS < len(order):
            proven = False
            break
    true_a, true_b = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, int), np.empty(0, int))
    _, place, links = np.unique(true_a, return_inverse=True, return_counts=True)
    beam = BEAM
    while True:
        exact = not proven or beam >= EXACT_SHARE * len(indexed)
        if exact:
            a, b = near_pairs(queries, indexed, threshold)
        else:
            ids, sims = graph.search(queries.astype(np.float32), beam, np.arange(len(queries)) if same else None)
            a, k = np.nonzero(sims >= threshold - 1e-4)
            b = ids[a, k]
            keep = verified(queries, indexed, a, b, threshold)
            a, b = a[keep], b[keep]
        root = roots_of(a, b + shift, n)
        # each vector counts once, however many links it has
        recall = 1.0 if not proven else float((np.bincount(place, root[true_a] == root[true_b + shift]) / links).mean()) if len(links) else None
        if exact or recall is None or recall >= AUDIT_RECALL:
            return root, recall
        beam *= 2


def vector_links(rows: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that join all vectors found near each other; rows: uid long, label, dim, vector array<double>, read twice. The table also holds each block's recall, in rows of null links (audit_of)."""
    sizes = rows.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    dealt = rows.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("uid"), F.col("shards")))

    folder = new_path(rows.sparkSession, "graph-files")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        graph = Graph(vectors.astype(np.float32))
        path = f"{folder}/{uuid.uuid4().hex}"  # a repeated task writes another file; the table names those that count
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        with filesystem(path)[0].open_output_stream(filesystem(path)[1]) as out:
            out.write(pickle.dumps((pdf["uid"].to_numpy(), vectors, graph.links, graph.top, graph.entry), 5))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "path": [path]})

    label = rows.schema["label"].dataType.simpleString()
    indexes = materialise(dealt.drop("shards").groupBy("label", "dim", "shard").applyInPandas(build, f"label {label}, dim int, shard long, path string"), "graphs")
    blocks = indexes.select("label", "dim", F.col("shard").alias("block"), F.col("path").alias("queries"))

    def load(path: str):
        fs, place = filesystem(path)
        with fs.open_input_stream(place) as data:
            return pickle.loads(data.read())

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        uids, vectors, links, top, entry = load(pdf["path"].iloc[0])
        graph = Graph.__new__(Graph)
        graph.points, graph.links, graph.top, graph.entry = vectors.astype(np.float32), links, top, entry
        same = pdf["shard"].iloc[0] == pdf["block"].iloc[0]
        own_uids, own = (uids, vectors) if same else load(pdf["queries"].iloc[0])[:2]
        root, recall = linked(graph, vectors, own, same, threshold)
        names = own_uids if same else np.concatenate([own_uids, uids])
        moved = np.flatnonzero(root != np.arange(len(root)))
        links = pd.DataFrame({"a": pd.array(names[moved], "Int64"), "b": pd.array(names[root[moved]], "Int64"), "recall": np.nan})
        audit = pd.DataFrame({"a": pd.array([None], "Int64"), "b": pd.array([None], "Int64"), "recall": [np.nan if recall is None else recall]})
        return pd.concat([audit, links])[["a", "b", "recall"]].assign(label=pdf["label"].iloc[0], dim=pdf["dim"].iloc[0], shard=pdf["shard"].iloc[0], block=pdf["block"].iloc[0])

    # every shard of a label meets every block of its vectors; a row here is a shard and a block, by the names of their files
    pairs = indexes.join(blocks, ["label", "dim"])
    # rows of a few bytes, seconds of work each: dealt by number, as partitions would be merged by their bytes into one task
    n = indexes.groupBy("label", "dim").agg((F.count("*") * F.count("*")).alias("n")).agg(F.sum("n")).first()[0]
    pairs = pairs.repartition(min(n or 1, SEARCH_TASKS), "label", "dim", "shard", "block")
    found = pairs.groupBy("label", "dim", "shard", "block").applyInPandas(search, f"a long, b long, recall double, label {label}, dim int, shard long, block long")
    return materialise(found, "links")


def audit_of(found: DataFrame) -> DataFrame:
    """label, dim, shard, block and recall of each block searched, from vector_links' table; recall is null where no vector had links."""
    return found.where("a IS NULL").select("label", "dim", "shard", "block", F.nanvl("recall", F.lit(None).cast("double")).alias("recall"))


def count_links(members: DataFrame, threshold: float = THRESHOLD, block_rows: int = COUNT_ROWS) -> DataFrame:
    """uid and n_near (vectors near it, its own among them) of all members(uid, component, n, vector), n being a node's vectors: exact, in each component block against block."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    left = dealt.select("component", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"), "uid", "n", "vector")
    right = dealt.select(F.col("component").alias("of"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("at"), F.col("own").alias("with"), F.col("uid").alias("mate"), F.col("n").alias("m"), F.col("vector").alias("beside"))

    def count(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"uid": np.array([], np.int64), "n": np.array([], np.int64)})
        x, y = (np.stack(p.to_numpy()).astype(np.float64) for p in (a["vector"], b["beside"]))
        x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        n, m = a["n"].to_numpy(), b["m"].to_numpy()
        of_x, of_y = [], np.zeros(len(y), np.int64)
        for at in range(0, len(x), 512):
            near = x[at : at + 512] @ y.T >= threshold
            of_x.append(near @ m)
            of_y += n[at : at + 512] @ near
        found = pd.DataFrame({"uid": a["uid"], "n": np.concatenate(of_x)})
        return found if key[1] == key[2] else pd.concat([found, pd.DataFrame({"uid": b["mate"], "n": of_y})])

    return left.groupBy("component", "i", "j").cogroup(right.groupBy("of", "at", "with")).applyInPandas(count, "uid long, n long").groupBy("uid").agg(F.sum("n").alias("n_near"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept of each row."""
    wide = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & F.col("label").isNotNull() & (F.size(wide) > 0) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0)
    slim = vectors.select(F.col(key), F.col(label).alias("label"), F.col(vector)).withColumn("good", F.coalesce(good, F.lit(False)))
    # scaled by the largest component, so that no norm overflows or vanishes
    scaled = F.transform(wide, lambda x: x / F.array_max(F.transform(wide, lambda y: F.abs(y))))
    rows = materialise(slim.select(key, "label", "good", F.size(wide).alias("dim"), F.when(F.col("good"), scaled).alias("vector")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    # equal vectors are one node, so that no beam fills with a vector's own copies
    kin = ["label", "dim", "vector"]
    nodes = materialise(rows.where("good").groupBy(*kin).agg(F.min("uid").alias("uid"), F.count("*").alias("n"), F.min(key).alias("least")), "nodes")
    owners = rows.where("good").join(nodes.select(*kin, F.col("uid").alias("node")), kin).select("uid", "node")
    links = vector_links(nodes.select("uid", *kin), threshold, shard_rows).where("a IS NOT NULL").select("a", "b")
    parts = materialise(connected_components(links), "components").withColumnRenamed("node", "uid")
    near = count_links(nodes.join(parts, "uid").select("uid", "component", "n", "vector"), threshold)
    named = nodes.select("uid", "n", "least").join(parts, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(least, "component").join(near, "uid", "left").select(F.col("uid").alias("node"), (F.coalesce("n_near", "n") - 1).alias("n_links"), "component_id")
    found = materialise(found, "found")
    out = rows.select("uid", key).join(owners.join(found, "node").drop("node"), "uid", "left").select(F.col(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", key).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: vec_id, n_links, component_id, kept."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
