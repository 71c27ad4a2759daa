"""Groups of linked rows: connected components, and greedy groups by first seed, in rounds on DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Links that one task may settle at the end of greedy_seeds.
FINISH_LINKS = 200_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of all nodes of links(a, b), by contraction to the smallest neighbour; only minima are aggregated."""
    star = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        new = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = new
    raise RuntimeError(f"components not settled in {most_rounds} rounds")


def greedy_seeds(links: DataFrame, finish: int = FINISH_LINKS) -> DataFrame:
    """seed: rows with later neighbours that no earlier seed is linked to; links(left_id, right_id), the earlier first.

    In each round, rows without an open earlier neighbour are settled as seeds, and their neighbours as taken; links of taken rows close.
    Once no more than `finish` links are open, one task settles them. Whoever was never taken is a seed.
    """
    open_ = written(links.select("left_id", "right_id").distinct(), "open")
    kind = dict(links.dtypes)["left_id"]
    every, gone = open_.select(F.col("left_id").alias("seed")).distinct(), []
    while (left := open_.count()) > finish:
        waiting = open_.select(F.col("right_id").alias("left_id")).distinct()
        seeds = open_.select("left_id").distinct().join(waiting, "left_id", "left_anti")
        taken = written(open_.join(seeds, "left_id").select(F.col("right_id").alias("id")).distinct(), "taken")
        gone.append(taken)
        open_ = written(open_.join(taken, F.col("left_id") == F.col("id"), "left_anti").join(taken, F.col("right_id") == F.col("id"), "left_anti"), "open")
    if left:

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            taken: set = set()
            for seed, own in pdf.sort_values(["left_id", "right_id"]).groupby("left_id", sort=True)["right_id"]:
                if seed not in taken:
                    taken.update(own)
            return pd.DataFrame({"id": list(taken)})

        gone.append(open_.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(settle, f"id {kind}"))
    for taken in gone:
        every = every.join(taken, F.col("seed") == F.col("id"), "left_anti")
    return every


def greedy_groups(links: DataFrame, finish: int = FINISH_LINKS) -> DataFrame:
    """seed_id, id, similarity of links(left_id, right_id, similarity): each row goes to the first seed it is linked to; a seed's own similarity is 1."""
    links = written(links.select("left_id", "right_id", "similarity"), "similar")
    seeds = written(greedy_seeds(links, finish), "seeds")
    owned = links.join(seeds, F.col("left_id") == F.col("seed")).groupBy(F.col("right_id").alias("id")).agg(F.min(F.struct("left_id", "similarity")).alias("s"))
    owned = written(owned.select(F.col("s.left_id").alias("seed_id"), "id", F.col("s.similarity").alias("similarity")), "owned")
    return owned.select("seed_id", F.col("seed_id").alias("id"), F.lit(1.0).alias("similarity")).distinct().unionByName(owned)
