"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, sized_join


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: any sortable type) to (node, root): the smallest node of its component, for nodes with edges.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest; the number of edges never
    grows and the rounds grow with the logarithm of the longest path. The smallest neighbours are sums of partial
    minima in a table of their own with a row a node, so that in the join back a node with very many edges is broadcast
    or split by adaptive execution. Tables are read back in as many partitions as their rows ask for (see
    :func:`common.fitted`), so that the rounds over few edges don't pay for tasks without work. It ends when the edges are
    stars: each node linked to one that is linked to none."""

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m"))
        both = both.unionByName(e.select(F.col("b").alias("n"), F.col("a").alias("m"))) if larger else both
        low = fitted(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")), "cc-low")
        linked = sized_join(both, low, "n").where("m > n" if larger else "true").select(F.col("m").alias("a"), F.col("low").alias("b"))
        if not larger:
            linked = linked.unionByName(low.select(F.col("n").alias("a"), F.col("low").alias("b")))
        return normal(linked)

    def normal(e: DataFrame) -> DataFrame:
        return fitted(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")

    def settled(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("up")))
        return ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 OR ups = 1 AND low = 0").isEmpty()

    now = normal(edges)
    for _ in range(rounds):
        if settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = star(star(now, True), False)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
