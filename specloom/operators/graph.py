"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions.scratch import Scratch


def components(edges: DataFrame, a: str, b: str, name: str = "graph") -> DataFrame:
    """(node, root): for every node of an edge, the smallest node that it can reach.

    Rounds of smallest label among neighbours, then label of the label; each round is written to the
    shared folder. A star takes two rounds and a path of n nodes about log n. Null ends are ignored.
    Every step aggregates by partial minima or is a plain equi-join that adaptive execution can split.
    """
    scratch = Scratch(edges.sparkSession, name)
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    both = scratch.keep(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", few=1)
    labels = scratch.keep(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("root")), "0", few=1)
    turn = 0
    while True:
        turn += 1
        seen = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        lower = labels.join(seen, "u").select("u", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("u").alias("low"), F.col("root").alias("far"))
        moved = lower.join(jump, "low", "left").select("u", F.coalesce(F.least("low", "far"), "low").alias("root"), (F.coalesce(F.least("low", "far"), "low") != F.col("root")).alias("moved"))
        moved = scratch.keep(moved, str(turn), few=1)
        if not moved.filter("moved").limit(1).count():
            return moved.select(F.col("u").alias("node"), "root")
        labels = moved.drop("moved")
