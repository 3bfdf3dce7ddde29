"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import keys
from .common import checkpoint


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour that is larger (large star), or not larger (small star), to
    the least node of its neighbourhood. The least is an aggregate with a map-side step and is
    joined back by `keys.attach`, which lets adaptive execution split a node with very many neighbours."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = keys.attach(both.filter("b > a"), least, "a", "inner", null_safe=False).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = (keys.attach(down, least, "a", "inner", null_safe=False).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `label` for each node of the links `a`, `b` (longs): the label is the least
    node reachable. Nodes without a link to another node are left out.

    Large and small stars alternate until the links no longer change; the number of
    rounds grows with the logarithm of the longest chain. Each round is checkpointed.
    """
    links = checkpoint(links.filter("a <> b").select("a", "b").distinct())
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"),
                          F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == seen or not state["n"]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = tuple(state)
        links = checkpoint(_star(_star(links, large=True), large=False))
