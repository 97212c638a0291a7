"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.common import cut, discard, join_hot

#: Rounds after which the job fails rather than give parts of components; the rounds needed grow with the logarithm of the longest chain.
MAX_ROUNDS = 60
HOT = 1_000


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node. Nulls and loops are dropped.

    Both steps hang each node below a smaller neighbour, so the edges end as stars around the smallest nodes. Minima are
    aggregated before they are shuffled, and no step gathers a node's neighbours in one task: they come back by a join, of
    nodes with very many edges by a broadcast one. ``rows``, where known, is how many edges there may be.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", rows)
    for _ in range(MAX_ROUNDS):
        both, size = now.union(now.select("b", "a")), 2 * now.count()
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("a", "m"))
        large = join_hot(both, low, "a", size, HOT).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        nxt = small.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        nxt = cut(nxt, "edges", rows)
        # Stars: every leaf has one centre, and no centre is a leaf.
        ends = nxt.select(F.col("a").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")).union(nxt.select("b", F.lit(1), F.lit(0)))
        still = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf = 1 and centre = 1").limit(1).count()
        discard(now)
        now = nxt
        if not still:
            leaf = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return leaf.union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    raise RuntimeError("components did not settle")
