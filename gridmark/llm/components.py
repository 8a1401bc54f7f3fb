"""Connected components of a graph given as links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.session import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable over links(a, b).

    In every round a node takes the smallest label among its neighbours, then the label of that
    label, so chains shrink by half. Each round is stored in the shared folder, which cuts the
    lineage. Nodes without links are not listed. A link needs both ends.
    """
    pairs = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    both = materialize(pairs.unionAll(pairs.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("seen")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "seen").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("component").alias("root"))
        step = materialize(
            lower.join(jump, "step", "left").select("node", "before", F.least(F.col("step"), F.coalesce("root", "step")).alias("component"))
        )
        changed = step.where(F.col("before") != F.col("component")).limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
