"""Connected components by minimum labels with pointer jumping, on the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, shared_path, written


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node in edges (a, b).

    Each round gives a node the smallest label among its own and its neighbours', then that label's own
    label; a star is done in two rounds, and distances halve after that. Every round is written as Parquet,
    from which Spark takes neither lineage nor constraints on to the next, and the round before is removed."""
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
    first.write.parquet(path := shared_path(spark, "labels"))
    labels = spark.read.parquet(path)
    while True:
        told = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        lower = told.unionByName(labels.withColumn("own", F.col("label"))).groupBy("node").agg(F.max("own").alias("old"), F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("label").alias("jumped"))
        now = lower.join(jump, F.col("label") == F.col("j_node"), "left").select("node", "old", F.least("label", F.coalesce("jumped", "label")).alias("label"))
        now.write.parquet(after := shared_path(spark, "labels"))
        removed(spark, path)
        path, now = after, spark.read.parquet(after)
        labels = now.select("node", "label")
        if now.filter("old <> label").isEmpty():
            return labels
