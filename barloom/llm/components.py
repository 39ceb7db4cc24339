"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.toDF("u", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge of ``edges`` (two columns of one orderable type); root is the smallest node.

    Hubs cost no group: minima are combined map-side, and the joins back are plain equi-joins that adaptive execution
    can split. Each round is written to the shared folder, in place of the one before; the rounds grow with the logarithm of the longest path.
    No edges give no rows; loops, repeats and either direction are allowed.
    """
    a, b = edges.columns
    edges = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = written(edges), None
    while True:
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            return edges.toDF("node", "root").union(edges.select("v", "v").distinct())
        before = sign
        edges = written(_small(_large(edges)), instead_of=edges)
