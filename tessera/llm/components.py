"""Connected components of a graph held as a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of links (u, v): root is the smallest node that can be reached.

    A large star joins every node's greater neighbours to its smallest one, a small star its smaller
    neighbours; after few rounds (about the logarithm of a component's width) only stars are left.
    Every round is written to the shared folder. Self-links and repeated links don't matter; an empty
    table gives no row. The minima are stored before they meet the links again, so that a hub's many
    links are an ordinary skewed join, which adaptive execution splits.
    """
    now = stored(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = both.where(F.col("v") > F.col("u")).join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        lower = stored(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        moved = large.join(lower, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(moved.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components: links still change after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("u")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
