"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on the least node among its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    # A hub's links are many: the join's large partitions can be split.
    return both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the least of them. A node has few smaller neighbours after a large star, so a window does it."""
    pair = F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
    hung = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return hung.select(F.explode(F.array(*pair)).alias("e")).select("e.*").where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root) for every linked node, root being the least node of its component."""
    spark = links.sparkSession
    edges, path = common.store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        after, after_path = common.store(_small_star(_large_star(edges)), "links")
        new = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        common.drop(spark, path)
        edges, path = after, after_path
        if new == mark:
            break
        mark = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
