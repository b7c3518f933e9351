"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable over edges(a, b); only nodes that have an edge appear.

    Each round takes the smallest label among neighbours, then follows labels of labels. The minimum is summed up before
    the shuffle; the label that most nodes of a large component share is the key of a join between two written tables,
    whose large partitions adaptive execution splits. Each half of a round is a table in the shared folder.
    Null ends and loops are ignored; no edges give no rows.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = cut(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("now"), "label"), "cc-step")
        up = step.select(F.col("node").alias("now"), F.col("now").alias("up"))
        step = cut(step.join(up, "now", "left").select("node", F.least("now", F.coalesce("up", "now")).alias("now"), "label"), "cc")
        if not step.where("now < label").limit(1).count():
            return labels
        labels = step.select("node", F.col("now").alias("label"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
