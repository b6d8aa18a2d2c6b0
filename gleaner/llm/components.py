"""Connected components of an edge table, by contraction: no task or driver holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that it can reach) for every end of edges(a, b).

    In each round every node points at its smallest neighbour if that is smaller, pointers are followed twice, and
    edges move to where their ends point; the rounds grow with the logarithm of the longest path.
    """
    left = staged(spark, edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        point = staged(spark, first)
        for _ in range(2):
            on = point.select(F.col("node").alias("via"), F.col("to").alias("further"))
            point = point.join(on, point["to"] == on["via"]).select("node", F.col("further").alias("to"))
        point = staged(spark, point)
        a, b = (point.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        left = staged(spark, left.join(a, "a").join(b, "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        if label is None:
            label = point.select("node", F.col("to").alias("label"))
        else:
            on = point.select(F.col("node").alias("via"), F.col("to").alias("further"))
            label = staged(spark, label.join(on, label["label"] == on["via"], "left").select("node", F.coalesce("further", "label").alias("label")))
    return label if label is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
