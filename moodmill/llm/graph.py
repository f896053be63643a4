"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import side_of, stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component_id) for every node of ``links`` (a, b): the smallest node reachable.

    Alternates two steps until the links no longer change: each node hands its
    smallest neighbour to its larger ones, then to its smaller ones. Every step
    is a grouped minimum and a join, so no node's neighbours are ever gathered
    in one place; the number of rounds grows with the logarithm of the longest
    chain. Each round is stored, so a lost executor costs one round at most.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    rows, last = edges.count(), None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(side_of(low, 2 * rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side_of(least, rows), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        rows, last = now[0], now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return side_of(edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(roots), 2 * rows)
