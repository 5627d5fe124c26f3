"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbalance.llm.common import cut


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them. Edges go down (u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.explode(F.array("u", "v")).alias("u")
    return edges.join(least, "u").select(ends, F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of ``edges(u, v)`` that isn't its component's smallest, which is the
    label. Each round is written out, so that plans stay small; rounds grow with the logarithm of a
    component's diameter. It is done when the edges are stars: no node points on that is pointed to,
    and none points to two."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        now = cut(_small(_large(now)))
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("out")))
        if ends.groupBy("x").agg(F.sum("out").alias("n"), F.min("out").alias("least")).where("n > 1 or (n = 1 and least = 0)").isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("label"))
