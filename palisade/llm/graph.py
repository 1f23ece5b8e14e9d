"""Connected components by contraction, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import cut


def _follow(parent: DataFrame) -> DataFrame:
    """Let every node point at the end of its chain; chains halve with each join."""
    while True:
        up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = cut(parent.join(up, F.col("root") == F.col("_n"), "left").select(
            "node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")))
        parent = jumped.select("node", "root")
        if not jumped.where("_moved").limit(1).count():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected links ``a, b`` (longs) that is not itself the smallest reachable.

    Each round hooks a node to its smallest neighbour below it, follows the
    chains to their ends and keeps the links between different ends.  At least
    half of the nodes that still have links vanish in a round.  Nulls and
    links of a node with itself mean nothing.  No links: no rows.
    """
    links = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    links = cut(links)
    known = None
    while True:
        if not links.limit(1).count():
            return known if known is not None else links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        parent = _follow(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        to = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        if known is None:
            known = parent
        else:
            moved = known.join(to, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
            known = cut(moved.unionByName(parent))
        high = links.join(to, F.col("hi") == F.col("_n"), "left").select(F.coalesce("_r", "hi").alias("hi"), "lo")
        both = high.join(to, F.col("lo") == F.col("_n"), "left").select("hi", F.coalesce("_r", "lo").alias("lo"))
        links = cut(both.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
