"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _settled(edges: DataFrame) -> bool:
    """Every node has one parent at most, and no parent has one: stars, and so components."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("a")).head()  # type: ignore[misc]
    return n == nodes and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a long, b long)``: root is the
    least node that it reaches.

    Alternating large-star and small-star rounds; each replaces edges by edges
    to a least neighbour, found by a combining aggregate.  Those aggregates and
    every round are written to the shared folder, so that both sides of a join are
    plain tables and Spark can split the edges of a node that has very many.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # large star: every larger neighbour goes to the least of the neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        drop(spark, least)
        # small star: a node and its smaller neighbours go to the least of them
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = written(small)
        drop(spark, now, large, least)
        now = small
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
