"""Connected components by randomised contraction.

In each round every node picks, among itself and its neighbours, the one with the smallest hash (another hash in each
round), edges are moved to what their ends picked, and loops and repeated edges go. Stars collapse in one round, and
even on paths a constant share of the nodes goes in each. Labels follow the picks; when no edge is left, the nodes with
one label are a component. Everything stays in tables; each round is cut off with a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that occurs in ``edges`` (a, b: long)."""
    live = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, rounds = None, 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hash_of = lambda c, r=rounds: F.xxhash64(F.lit(r), F.col(c))
        near = both.groupBy("a").agg(F.min(F.struct(hash_of("b").alias("h"), F.col("b").alias("node"))).alias("near"))
        own = F.struct(hash_of("a").alias("h"), F.col("a").alias("node"))
        picks = checkpointed(near.select(F.col("a").alias("node"), F.least(own, F.col("near"))["node"].alias("pick")))
        if labels is None:
            labels = picks.select("node", F.col("pick").alias("label"))
        else:
            labels = labels.join(picks.select(F.col("node").alias("label"), "pick"), "label", "left").select(
                "node", F.coalesce("pick", "label").alias("label"))
        labels = checkpointed(labels)
        moved = (
            live.join(picks.select(F.col("node").alias("a"), F.col("pick").alias("pa")), "a")
            .join(picks.select(F.col("node").alias("b"), F.col("pick").alias("pb")), "b")
            .where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        live, rounds = checkpointed(moved), rounds + 1
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
