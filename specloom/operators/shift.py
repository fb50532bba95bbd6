"""Axis shifts between spectra of a shared axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.operators.images import overview_shared_axis, partial_sums


def shift_map(spectra: DataFrame, centre: float, tol: float, least: float = 0.3) -> DataFrame:
    """How many samples the highest sample of each spectrum in [centre - tol, centre + tol) is from the mean spectrum's, and how far.

    0 where the spectrum's maximum is not above `least` times the mean spectrum's. First of equal maxima.
    """
    inside = (F.col("mz") >= centre - tol) & (F.col("mz") < centre + tol)
    top = lambda y: F.max_by(F.struct("pos", "mz", F.col(y).alias("y")), F.struct(y, -F.col("pos")))
    mean = overview_shared_axis(spectra).filter(inside).groupBy("dataset_id").agg(top("mean").alias("_m"))
    each = F.transform("ints", lambda y, i: F.struct(y.cast("double").alias("y"), (-i).alias("_back"), i.alias("pos"), F.get("mzs", i).alias("mz")))
    held = F.filter(each, lambda p: (p["mz"] >= centre - tol) & (p["mz"] < centre + tol))
    own = spectra.select("dataset_id", "spectrum_id", "x", "y", "z", F.array_max(held).alias("_o")).filter("_o is not null")
    high = F.col("_o.y") > F.col("_m.y") * least
    return own.join(mean, "dataset_id").select(
        "dataset_id", "spectrum_id", "x", "y", "z",
        F.when(high, F.col("_o.pos") - F.col("_m.pos")).otherwise(0).alias("shift"),
        F.when(high, F.abs(F.col("_o.mz") - F.col("_m.mz"))).otherwise(0.0).alias("delta_mz"),
    )


def overview_shifted(spectra: DataFrame, shift: DataFrame) -> DataFrame:
    """Overview with every spectrum moved back by its shift; positions are counted on the axis padded by the largest shifts, which grows
    on both sides at the step of its ends (Q9)."""
    ends = shift.groupBy("dataset_id").agg(F.abs(F.least(F.min("shift"), F.lit(0))).alias("_down"), F.greatest(F.max("shift"), F.lit(0)).alias("_up"))
    axes = spectra.groupBy("dataset_id").agg(F.first("mzs").alias("_axis"), F.count(F.lit(1)).alias("_n"))
    moved = spectra.join(shift.select("dataset_id", "spectrum_id", "shift"), ["dataset_id", "spectrum_id"]).select("dataset_id", "shift", "mzs", "ints")
    sums = partial_sums(moved, ("dataset_id", "shift")).groupBy("dataset_id", (F.col("pos") - F.col("shift")).alias("at")).agg(F.sum("sum").alias("sum"), F.greatest(F.max("max"), F.lit(0.0)).alias("max"))
    out = sums.join(axes, "dataset_id").join(ends, "dataset_id")
    n, axis, at = F.size("_axis"), F.col("_axis"), F.col("at")
    low, high = F.get(axis, F.lit(0)), F.element_at(axis, -1)
    mz = F.when(at < 0, low + at * (F.get(axis, F.lit(1)) - low)).when(at >= n, high + (at - n + 1) * (high - F.element_at(axis, -2))).otherwise(F.get(axis, F.greatest(F.lit(0), F.least(at, n - 1))))
    # moved up by the largest shift ahead, so that positions count from 0
    return out.select("dataset_id", (at + F.col("_up")).cast("int").alias("pos"), mz.alias("mz"), "sum", (F.col("sum") / F.col("_n")).alias("mean"), "max")
