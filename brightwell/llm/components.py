"""Distributed union-find by alternating large and small stars, in DataFrame operations only.

Every round writes its edges to the shared folder and reads them again, so lineage stays short
and a lost executor costs one round at most. Minima are combined before the shuffle, and a node
of very many neighbours meets the others in a join, which Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.llm.shared import drop_path, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _is_stars(edges: DataFrame, n: int) -> bool:
    """Whether each edge leads from a node of one edge to a root."""
    if edges.select("a").distinct().count() < n:
        return False
    return not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()


def connected_components(edges: DataFrame, label: str = "components") -> tuple[DataFrame, str]:
    """(node, root) for every node of edges (a, b), which may repeat and be in any order; and where it is written.

    root is the smallest node of the component. Nodes may be of any type that Spark orders;
    rows with a null end or with equal ends link nothing and are left out.
    """
    spark = edges.sparkSession
    now, path = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), None
    n = edges.count()
    while True:
        following, at = written(_small_star(_large_star(now)), label, n)
        if path:
            drop_path(spark, path)
        now, path, n = following, at, following.count()
        if _is_stars(now, n):
            break
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return found, path
