"""Near copies of documents: groups linked by Jaccard similarity 0.8 or more of five-word shingle sets.

Equal sets are one node. Candidates come from operator 4's ball hashing of SimHash fingerprints over the same shingles, and, as
sets of similarity 0.8 differ in about ten of 64 bits, beyond the reach of any ball, from MinHash bands as well: a pair at
the least similarity shares one of BANDS bands of ROWS minima with probability 1 - (1 - 0.8 ** 5) ** 24 = 0.9999, more
similar pairs sooner. All candidates are verified by their exact sets. First each node is held against the smallest of its
ball and of each of its bands. Nodes in bands that still span several components form the
group of the band's hub. Each is taken by the shingles in which it differs from the group's centre, the shingles that over half
of the group hold. Two nodes that differ little enough from the centre are similar without a comparison, and are linked with the one that differs
least; any others that are similar have such a shingle in common, and an early one with rare ones first. So every pair of a group that can be
similar and lies in different components is verified, while edits of one text that are too far apart, or sets around one
passage, differ from the centre in shingles of their own and mostly are not paired.

Words are as in simhash; a shorter text is one shingle; texts without words are equal; nulls are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, give_back, materialise, only_rows, text_batches
from .simhash import ball_links, majority_bits, shingle_hashes

SHINGLE_WORDS = 5
#: Least similarity of a link, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 24, 5
SEED = 42
_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS, SEED))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed long for each band, none for an empty set."""
    import xxhash

    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((FACTORS * hashes[None, at : at + 1024] + SHIFTS) >> np.uint64(16)).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(own.tobytes(), i) for i, own in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * LEAST[1] >= LEAST[0] * (len(a) + len(b) - common)


def with_sketches(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, digest (of the shingle set), n (its size), fp (SimHash of the shingles) and bands; the text itself does not travel on."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def sketch(batches):
        import xxhash

        give_back()  # an earlier stage's memo, which would stay beside all that follows
        for batch in batches:
            for some in text_batches(batch, "__text"):
                every = [shingle_hashes(t, SHINGLE_WORDS, SEED) for t in some["__text"].tolist()]
                sets, fp = [np.unique(h) for h in every], np.array([majority_bits(h) for h in every], np.uint64).view(np.int64)
                yield some.drop(columns="__text").assign(digest=[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], n=[len(s) for s in sets], fp=fp, bands=[bands(s) for s in sets])
        every = sets = fp = some = batch = None
        give_back()

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", digest binary, n long, fp long, bands array<long>"
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInPandas(sketch, schema)


def _sets(df: DataFrame, key: str, text: str) -> DataFrame:
    def hashes(batches):
        for batch in batches:
            for some in text_batches(batch, "__text"):
                yield some[["node"]].assign(hashes=[shingle_set(t).tobytes() for t in some["__text"].tolist()])
        some = batch = None
        give_back()

    return df.select(F.col(key).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInPandas(hashes, "node long, hashes binary")


def _sets_of(nodes: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """Table of node and hashes (its shingle set) for the given nodes(node)."""
    needed = materialise(nodes.select(F.col("node").alias(key)).distinct(), "needed")
    return materialise(_sets(only_rows(rows, needed, key), key, text), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")

    def verify(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            of = lambda c, i: np.frombuffer(c[i].as_buffer(), np.uint64)
            yield batch.select(["a", "b"]).filter(pa.array([similar(of(x, i), of(y, i)) for i in range(batch.num_rows)], pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def near(m: Column, n: Column) -> Column:
    """Whether sets of m and n shingles can be similar."""
    return F.least(m, n) * LEAST[1] >= F.greatest(m, n) * LEAST[0]


def group_deltas(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members(hub, node) with n (the size of the node's set), d and delta: the shingles in which it differs from the centre of its hub's
    group, that is from the shingles that over half of the group hold."""

    def shingles(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column("hashes")[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column("hub")[i].as_py())), pa.array(own)], ["hub", "shingle"])

    def differences(batches):
        for batch in batches:
            rows = [[], [], []]
            for own, centre in zip(batch.column("hashes"), batch.column("centre")):
                own = np.frombuffer(own.as_buffer(), np.int64)
                delta = np.setxor1d(own, centre.values.to_numpy() if centre.is_valid else own[:0], assume_unique=True)
                for column, value in zip(rows, (len(own), len(delta), delta)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("node"), *map(pa.array, rows[:2]), pa.array(rows[2], pa.list_(pa.int64()))], ["hub", "node", "n", "d", "delta"])

    held = materialise(members.join(sets, "node").select("hub", "node", "hashes"), "members")
    sizes = members.groupBy("hub").agg(F.count("*").alias("size"))
    owners = held.select("hub", "hashes").mapInArrow(shingles, "hub long, shingle long").groupBy("hub", "shingle").agg(F.count("*").alias("owners"))
    centres = owners.join(sizes, "hub").where("2 * owners > size").groupBy("hub").agg(F.collect_list("shingle").alias("centre"))
    return materialise(held.join(centres, "hub", "left").select("hub", "node", "hashes", "centre").mapInArrow(differences, "hub long, node long, n long, d long, delta array<long>"), "deltas")


def sure_links(deltas: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes of a group whose differences are so small together that they are similar, whichever shingles these are.

    Two such nodes have slacks of at least zero together, so both have with the node of the group's greatest slack.
    """
    slack = deltas.select("hub", "node", (F.col("n") * (LEAST[1] - LEAST[0]) - F.col("d") * (LEAST[0] + LEAST[1])).alias("slack"))
    best = slack.groupBy("hub").agg(F.max(F.struct("slack", "node")).alias("best"))
    return slack.join(best, "hub").where((F.col("slack") + F.col("best.slack") >= 0) & (F.col("node") != F.col("best.node"))).select(F.col("best.node").alias("a"), F.col("node").alias("b"))


def delta_pairs(deltas: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different components in one group: all that are similar and not under sure_links, and few others.

    Sets of sizes m and n are similar if they differ in (m + n) / 9 shingles or fewer, and they differ where one delta and not the other has a
    shingle. So the deltas of a similar pair have a shingle in common, unless they have (m + n) / 9 together or fewer, and with all in one order, rare
    ones first, (m + n) / 9 others or fewer come before the first common one. Shingles of one component's deltas only can't be common:
    they come first and shift the places of the others. parts: node, component.
    """
    named = deltas.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = named.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("hub")
    named = materialise(named.join(spread, "hub", "left_semi"), "open-deltas")
    every = named.select("hub", "node", "component", F.explode("delta").alias("shingle"))
    shared = every.groupBy("hub", "shingle").agg(F.count("*").alias("owners"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("hub", "shingle", "owners")
    ranked = every.join(shared, ["hub", "shingle"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("owners", "shingle"))).alias("ranked"))
    placed = named.drop("delta").join(ranked, ["hub", "node"]).withColumn("before", F.col("d") - F.size("ranked"))
    part, whole = LEAST[1] - LEAST[0], LEAST[0] + LEAST[1]
    # of a larger set, 5/4 of this one at most, and this one together
    most = F.floor(F.col("n") * part / LEAST[0])
    prefix = placed.select("hub", "node", "n", "d", "component", "before", F.posexplode(F.slice("ranked", F.lit(1), F.greatest(most + 1 - F.col("before"), F.lit(0)).cast("int"))).alias("i", "own"))
    prefix = materialise(prefix.select("hub", F.col("own.shingle").alias("shingle"), "node", "n", "d", "component", (F.col("before") + F.col("i")).alias("place")), "prefixes")
    a, b = prefix.where(F.col("place") * 2 <= most).alias("a"), prefix.alias("b")
    left = F.least(F.col("a.d") - F.col("a.place"), F.col("b.d") - F.col("b.place"))
    total = (F.col("a.n") + F.col("b.n")) * part
    able = near(F.col("a.n"), F.col("b.n")) & ((F.col("a.place") + F.col("b.place")) * whole <= total) & ((F.col("a.d") + F.col("b.d") - 2 * left) * whole <= total)
    ordered = F.struct("a.place", "a.node") < F.struct("b.place", "b.node")
    found = a.join(b, (F.col("a.hub") == F.col("b.hub")) & (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.component") != F.col("b.component")) & ordered & able)
    return found.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def _ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b: each node with the smallest of its fingerprint, and these where two fingerprints lie in one ball."""
    least = materialise(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "fingerprints")
    same = nodes.join(least, "fp").where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = ball_links(least.select("fp"))
    a, b = least.select(F.col("fp").alias("a"), F.col("hub").alias("x")), least.select(F.col("fp").alias("b"), F.col("hub").alias("y"))
    return same.unionByName(links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_copy_classes(rows: DataFrame, key: str = "row_no", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep and component_id (the smallest key reachable by links) of all rows; key is a long that no two rows share.

    rows is read up to three times and should be a table.
    """
    sketches = materialise(with_sketches(rows, text, (key, *keep)), "sketches")
    nodes = materialise(sketches.groupBy("digest").agg(F.min(key).alias("node"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "nodes")
    entries = nodes.select("node", "n", F.explode("bands").alias("band"))
    hubs = entries.groupBy("band").agg(F.count("*").alias("owners"), F.min(F.struct("node", "n")).alias("hub")).where("owners > 1")
    entries = materialise(entries.join(hubs, "band").select("band", "node", "n", "hub"), "bands")
    first = entries.where((F.col("hub.node") < F.col("node")) & near(F.col("hub.n"), F.col("n")))
    first = first.select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    first = materialise(first.unionByName(_ball_pairs(nodes)).distinct(), "first-pairs")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    links = materialise(_verified(first, _sets_of(ends(first), rows, key, text)), "first-links")
    parts = connected_components(links)
    owned = entries.select("band", "node", F.col("hub.node").alias("hub")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = owned.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    members = materialise(owned.join(spread, "band", "left_semi").select("hub", "node").distinct(), "groups")
    sets = _sets_of(members.select("node"), rows, key, text)
    deltas = group_deltas(members, sets)
    links = materialise(links.unionByName(sure_links(deltas)), "sure-links")
    parts = connected_components(links)
    rest = materialise(delta_pairs(deltas, parts).join(first, ["a", "b"], "left_anti"), "pairs")
    more = materialise(_verified(rest, sets), "links")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))
    named = nodes.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return sketches.join(named, "digest").select(key, *keep, "component_id")
