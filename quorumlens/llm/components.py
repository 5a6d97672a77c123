"""Connected components of an edge table by alternating large and small stars, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import FEW, new_path, remove


def star(edges: DataFrame, large: bool, few: bool = False) -> DataFrame:
    """Link each node's larger (large) or smaller neighbours, and itself, to the least of them all.

    edges (a, b) have a < b. No neighbourhood is gathered: edges are joined with their node's least one.
    Edges are never broadcast, as few bytes of a file may hold very many; the least ones only if they are told to be few.
    """
    least_of = F.broadcast if few else lambda least: least.hint("merge")
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # a node's larger neighbours: the pairs a < b; its own link follows where it isn't the least
        out = edges.join(least_of(least), "a").select(F.col("m").alias("a"), "b")
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        out = edges.join(least_of(least), "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return out.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b: long): root is the least node that it is linked to through any chain.

    Ends when every node hangs on its root, after a number of steps that grows with the logarithm of the chains' lengths.
    """
    spark = edges.sparkSession
    path = new_path(spark, "links")
    edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct().write.parquet(path)
    seen = None
    while True:
        now = spark.read.schema("a long, b long").parquet(path)
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.approx_count_distinct("a") + F.approx_count_distinct("b")).first()
        if tuple(told) == seen or not told[0]:
            out = now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
            out.written_at = path  # for forget()
            return out
        seen = tuple(told)
        for large in (True, False):
            was, path = path, new_path(spark, "links")
            star(spark.read.schema("a long, b long").parquet(was), large, told[2] <= FEW).write.parquet(path)
            remove(spark, was)
