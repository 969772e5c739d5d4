"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.sources.shared import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """node, root for every node that isn't the smallest of its component; links are (a, b) of any type that has an order.

    In every round a node's larger neighbours are hung under its smallest one, then its smaller ones are; the rounds
    end when every node hangs under one root only, after about the logarithm of the longest path.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    while True:
        seen = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
        chained = edges.join(edges.select(F.col("root").alias("node")), "node", "left_semi").select("node")
        if seen.union(chained).isEmpty():
            return edges
        around = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        lowest = around.groupBy("node").agg(F.min("root").alias("least")).withColumn("least", F.least("node", "least"))
        larger = around.join(lowest, "node").filter("root > node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        larger = written(larger.distinct())
        lowest = larger.groupBy("node").agg(F.min("root").alias("least"))
        smaller = larger.join(lowest, "node").select(F.when(F.col("root") == F.col("least"), F.col("node")).otherwise(F.col("root")).alias("node"), F.col("least").alias("root"))
        before, edges = edges, written(smaller.filter("node <> root").distinct())
        drop_written(before, larger)
