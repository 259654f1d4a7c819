"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctiluca.session import cut


SALTS = 16


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over (a, b). Nodes without edges don't occur.

    Every round gives a node the least label among its neighbours, then follows labels once more (pointer jumping), so
    chains shrink geometrically. Only minima are aggregated, which Spark combines before the shuffle, so a node with very
    many edges is no burden. Each round is written to the shared checkpoint folder. Raises if it doesn't converge.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("step"))
        # all nodes of a component ask for the same label: they do so under salts, and of the labels only those that have
        # moved on are sent to every salt
        jump = labels.where("component <> node").select(F.col("node").alias("step"), F.col("component").alias("further"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        after = cut(lower.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(jump, ["step", "salt"], "left").select("node", "was", F.least("step", F.coalesce("further", "step")).alias("component")))
        labels = after.select("node", "component")
        if after.where("component <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components: no convergence after {most_rounds} rounds")
