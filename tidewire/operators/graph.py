"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.shuffles import drop, join_unique, saved

#: A bound no graph meets: rounds grow with the logarithm of the longest chain.
MOST_ROUNDS = 200


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a long, b long) -> (node long, component long): the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours, hooks the node its old label names to it as well, so
    that whole stars move, and follows labels once more. It ends when no label changes, and only then; labels that are
    still open after MOST_ROUNDS are an error, never a result. Hubs and large components are no hot keys: their few rows
    are broadcast. Every round's labels are a saved table, which goes when the next one is there. An empty input gives an empty table."""
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    by_node = saved(both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("least")), f"{name}-degrees")
    labels = saved(by_node.select(F.col("a").alias("node"), F.least("a", "least").alias("component")), name)
    if labels.isEmpty():
        return labels
    degrees = by_node.select("a", "n")
    for _ in range(MOST_ROUNDS):
        near = join_unique(both, labels.withColumnRenamed("node", "a"), "a", counts=degrees).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        seen = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("near"))
        hooks = seen.where("near < was").groupBy(F.col("was").alias("node")).agg(F.min("near").alias("hook"))
        lower = saved(seen.join(hooks, "node", "left").select("node", "was", F.least("near", F.coalesce("hook", "near")).alias("component")), f"{name}-lower")
        further = labels.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = saved(join_unique(lower, further, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was"), name)
        done = after.where("component <> was").isEmpty()
        for old in (labels, lower):  # a round's tables serve the next one only
            drop(old)
        labels = after.select("node", "component")
        if done:
            drop(both)
            drop(by_node)
            return labels
    raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
