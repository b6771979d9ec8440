"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected with, for all ends of ``edges`` (``a``, ``b``: long).

    In each round every node hooks onto its smallest neighbour, pointers are doubled until all show to a root, and
    the edges between different roots are the next round's graph.  A round at least halves the number of roots that
    still have edges.  The tables joined are written before, so that a node with very many edges can be split; without a
    folder for them the plan would grow with each round, so one must be set.
    """
    spark = edges.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = durable(pairs.distinct())
    labels = None
    while left.take(1):
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            left.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        up = durable(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("up")))
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = durable(up.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")))
            up = jumped.select("node", "up")
            if not jumped.where("moved").take(1):
                break
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            higher = up.select(F.col("node").alias("component"), F.col("up").alias("top"))
            labels = durable(
                labels.join(higher, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            )
        of_a, of_b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = left.join(of_a, "a").join(of_b, "b").where("x <> y")
        left = durable(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
