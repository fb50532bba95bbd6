"""Order statistics of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.functions.scratch import Scratch, ranged


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, null with null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Keys and the median of a double column of each group, the mean of the middle two if there are two; nulls don't count.

    Values are sorted over range partitions, so no group's values meet in one task. Counts by partition and group tell which partitions
    hold the middle values, and only these are read again.
    """
    scratch = Scratch(df.sparkSession, "medians")
    blocks = ranged(scratch, df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null"), "values", *keys, "_v")
    counts = blocks.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select("_pid", *keys, "_n", before.alias("_before"), F.sum("_n").over(group).alias("_all"))
    ranks = [F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)]  # from 0
    held = reduce(lambda a, b: a | b, [r.between(F.col("_before"), F.col("_before") + F.col("_n") - 1) for r in ranks])
    wanted = scratch.keep(parts.filter(held).select("_pid", *keys, *[(r - F.col("_before")).alias(f"_r{i}") for i, r in enumerate(ranks)]), "wanted")
    line = Window.partitionBy("_pid", *keys).orderBy("_v")
    near = blocks.join(wanted, same(blocks, wanted, ["_pid", *keys])).select(blocks["_pid"], *[blocks[k] for k in keys], "_v", "_r0", "_r1")
    near = near.withColumn("_i", F.row_number().over(line) - 1)
    both = F.when(F.col("_i") == F.col("_r0"), F.col("_v")), F.when(F.col("_i") == F.col("_r1"), F.col("_v"))
    found = near.filter("_i = _r0 or _i = _r1").groupBy(*keys).agg(F.max(both[0]).alias("_a"), F.max(both[1]).alias("_b"))
    return found.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("_a") + F.col("_b")) / 2).alias(name))
