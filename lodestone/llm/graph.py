"""Connected components of an edge table, by star contraction with shared-folder checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for all nodes of ``edges`` (a long, b long).

    Each round gives every node the smallest label among its neighbours and itself (a partial
    aggregation, so a hub is pre-aggregated in every task), then lets labels point to their own
    labels. Rounds stop when none changes, which they must, since labels only fall; their number grows with the logarithm of chains' lengths.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("n"), "l"), "labels")
    while True:
        old = labels
        heard = both.join(old, both.b == old.n).select(F.col("a").alias("n"), "l")
        # a node also tells the node that labels it what it hears, so that chains contract
        best = heard.union(old).groupBy("n").agg(F.min("l").alias("l"))
        told = best.join(old.select(F.col("n").alias("m"), F.col("l").alias("was")), best.n == F.col("m")).select(F.col("was").alias("n"), "l")
        best = best.union(told).groupBy("n").agg(F.min("l").alias("l"))
        jump = best.select(F.col("n").alias("m"), F.col("l").alias("to"))
        labels = materialize(
            best.join(jump, best.l == jump.m, "left").select("n", F.coalesce("to", "l").alias("l")), "labels"
        )
        changed = labels.join(old.select(F.col("n").alias("m"), F.col("l").alias("was")), labels.n == F.col("m")).where("l <> was").limit(1).count()
        discard(old)
        if not changed:
            return labels.select(F.col("n").alias("node"), F.col("l").alias("component"))
