"""Connected components of a distributed edge table by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortcuts two steps, and keeps only the edges
    that still join different trees; at least half of a component's trees go each round.  Nothing but the
    question whether edges are left reaches the driver, and each round ends in a written table.
    """
    left = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        hooked = written(hooked.select(F.col("a").alias("node"), "p"))
        step = hooked.select(F.col("node").alias("p"), F.col("p").alias("q"))
        short = written(hooked.join(step, "p").select("node", F.col("q").alias("p")))
        maps.append(short)
        of = lambda side: short.select(F.col("node").alias(side), F.col("p").alias(f"{side}p"))  # noqa: E731, B023
        moved = left.join(of("a"), "a").join(of("b"), "b").where("ap <> bp")
        left = written(moved.select(F.greatest("ap", "bp").alias("a"), F.least("ap", "bp").alias("b")).distinct())
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = maps[0]
    for later in maps[1:]:
        labels = labels.join(later.select(F.col("node").alias("p"), F.col("p").alias("q")), "p", "left").select("node", F.coalesce("q", "p").alias("p"))
    return labels.select("node", F.col("p").alias("component"))
