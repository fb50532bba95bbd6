"""Images and overview spectra from spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.functions import arrays
from specloom.functions.selection import medians, same

PIXEL = ["dataset_id", "x", "y", "z"]


def points(spectra: DataFrame) -> DataFrame:
    """One row a sample: pos counts from 0."""
    rest = [c for c in spectra.columns if c not in ("mzs", "ints")]
    return spectra.select(*rest, F.posexplode(F.arrays_zip("mzs", "ints")).alias("pos", "_p")).select(*rest, "pos", F.col("_p.mzs").alias("mz"), F.col("_p.ints").alias("intensity"))


def apply_mask(df: DataFrame, mask: DataFrame, keep: bool = False) -> DataFrame:
    """Without rows outside the mask (label 0 or none); with keep, `value` becomes 0 there instead."""
    inside = mask.filter("label != 0").select(*PIXEL, F.lit(True).alias("_in"))
    if not keep:
        return df.join(inside.select(PIXEL), PIXEL, "left_semi")
    return df.join(inside, PIXEL, "left").withColumn("value", F.when(F.col("_in"), F.col("value")).otherwise(0.0)).drop("_in")


def norm_image(spectra: DataFrame, kind: str) -> DataFrame:
    factor = arrays.norm_factor(F.col("mzs"), F.col("ints"), kind, F.col("norm_infile"))
    return spectra.select(*PIXEL, arrays.image_factor(factor, F.col("ints")).alias("value"))


def ion_image(spectra: DataFrame, centre: float, tol: float, ppm: bool = False, pooling: str = "mean", centroid_norm: str | None = None, shift: DataFrame | None = None) -> DataFrame:
    """One value a pixel: processed profile spectra pooled over [centre - tol, centre + tol], without a shuffle.

    centroid_norm: for centroid data, divide by that factor; the pixel is 0 where it is not above 0 and finite.
    shift: moves each spectrum's window by its number of samples.
    """
    half = arrays.tolerance(F.lit(float(centre)), tol, ppm)
    low, high = centre - half, centre + half
    mzs, ints = F.col("mzs"), F.col("ints")
    if shift is not None:
        spectra = spectra.join(shift.select("dataset_id", "spectrum_id", "shift"), ["dataset_id", "spectrum_id"], "left")
        first = F.size(F.filter(mzs, lambda m: m < low))
        n = F.size(F.filter(mzs, lambda m: m.between(low, high)))
        start = first + F.coalesce("shift", F.lit(0))
        window = F.filter(ints, lambda _, i: (i >= start) & (i < start + n))
    else:
        window = arrays.subrange(mzs, ints, low, high)
    value = arrays.pool(window, pooling)
    if centroid_norm:
        factor = arrays.norm_factor(mzs, ints, centroid_norm, F.col("norm_infile"))
        ok = (factor > 0) & (factor < float("inf")) & ~F.isnan(factor)
        value = F.when(ok, arrays.pool(F.transform(window, lambda v: v / factor), pooling)).otherwise(0.0)
    return spectra.select(*PIXEL, "spectrum_id", value.alias("value"))


def bucketed(df: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    """df with one row a bucket of `width` that [low, high] touches, in `_bucket`."""
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def range_join(pts: DataFrame, intervals: DataFrame, centre: str = "x", tol: float = 0.0, ppm: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Points with every interval whose window holds them.

    Buckets are as wide as the widest window, so a window touches two at most and a point one: an
    equi-join on the bucket, and a check.
    """
    half = arrays.tolerance(F.col(centre), tol, ppm)
    windows = intervals.withColumn("_low", F.col(centre) - half).withColumn("_high", F.col(centre) + half)
    width = max(windows.agg(F.max(F.col("_high") - F.col("_low"))).first()[0] or 0.0, 1e-9)
    cut = bucketed(windows, F.col("_low"), F.col("_high"), width)
    return pts.withColumn("_bucket", F.floor(F.col("mz") / width)).join(cut, ["_bucket", *(keys or [])]).filter(F.col("mz").between(F.col("_low"), F.col("_high"))).drop("_bucket", "_low", "_high")


#: Intervals that a task may hold: two numbers and an id each. Values of a spectrum in a row, and of rows in a batch, that a task hands on.
LISTED, CELLS, BATCH_CELLS = 100_000, 1 << 12, 1 << 16


def feature_matrix(spectra: DataFrame, intervals: DataFrame, tol: float, ppm: bool = False, pooling: str = "mean") -> DataFrame:
    """Long form: one value for each spectrum and interval whose window holds samples, all intervals in one pass.

    A list of up to `LISTED` intervals goes to the tasks, which look its bounds up in the axis of each spectrum (once, while the axis stays the
    same): no sample is moved, and a task hands on so many values at a time, however many spectra and intervals there are. A longer list
    meets the samples by buckets.
    """
    wanted = intervals.select("interval_id", "x_mean").filter("x_mean is not null")
    half = arrays.tolerance(F.col("x_mean"), tol, ppm)
    bounds = wanted.select("interval_id", (F.col("x_mean") - half).alias("low"), (F.col("x_mean") + half).alias("high")).limit(LISTED + 1).toPandas()
    if len(bounds) > LISTED:
        hits = range_join(points(spectra), wanted, "x_mean", tol, ppm)
        by = {"mean": F.avg, "sum": F.sum, "maximum": F.max, "median": F.median}[pooling]
        return hits.groupBy("dataset_id", "spectrum_id", "x", "y", "z", "interval_id").agg(by("intensity").alias("value"))
    ids, low, high = (bounds[c].to_numpy() for c in ("interval_id", "low", "high"))
    keys = ["dataset_id", "spectrum_id", "x", "y", "z"]
    kind = wanted.schema["interval_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axis = None
        for batch in batches:
            mzs, ints = (batch.column(c) for c in ("mzs", "ints"))
            row, which, values, n = [], [], [], 0

            def cells() -> pa.RecordBatch:
                ends = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
                pairs = pa.StructArray.from_arrays([pa.concat_arrays(which), pa.array(np.concatenate(values))], names=["interval_id", "value"])
                rows = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in keys), pa.ListArray.from_arrays(ends, pairs)], names=[*keys, "cells"])

            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid else np.zeros(0) for c in (mzs, ints))
                if axis is None or not np.array_equal(axis, x):
                    axis, line = x, np.argsort(x, kind="stable")
                    ordered = x[line]
                    a, b = np.searchsorted(ordered, low, "left"), np.searchsorted(ordered, high, "right")
                    full = np.flatnonzero(b > a)
                    # intervals with the same samples share their value
                    once, of = np.unique(a[full] * (len(x) + 1) + b[full], return_inverse=True)
                    a, b = once // (len(x) + 1), once % (len(x) + 1)
                    pieces = [(of[k : k + CELLS], pa.array(ids[full[k : k + CELLS]])) for k in range(0, len(full), CELLS)]
                if not pieces:
                    continue
                value = pooled(y[line], a, b, pooling)
                for at, name in pieces:
                    row.append(i)
                    which.append(name)
                    values.append(value[at])
                    n += len(at)
                    if n >= BATCH_CELLS:
                        yield cells()
                        row, which, values, n = [], [], [], 0
            if row:
                yield cells()

    types = ", ".join(f"{k} {spectra.schema[k].dataType.simpleString()}" for k in keys)
    found = spectra.select(*keys, "mzs", "ints").mapInArrow(run, f"{types}, cells array<struct<interval_id: {kind}, value: double>>")
    return found.select(*keys, F.inline("cells"))


def pooled(y: np.ndarray, a: np.ndarray, b: np.ndarray, pooling: str) -> np.ndarray:
    """Mean, sum, maximum or median of y[a:b] for arrays of bounds, a below b."""
    if pooling == "median":
        return np.array([np.median(y[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    cuts = np.stack((a, b), axis=1).ravel()
    out = {"mean": np.add, "sum": np.add, "maximum": np.maximum}[pooling].reduceat(np.append(y.astype(float), 0.0), cuts)[::2]
    return out / (b - a) if pooling == "mean" else out


def wide(matrix: DataFrame, ids: list[int]) -> DataFrame:
    """One column an interval, for a given list; missing values are 0."""
    return matrix.groupBy("dataset_id", "spectrum_id", "x", "y", "z").pivot("interval_id", ids).agg(F.first("value")).na.fill(0.0)


# Overviews. A task adds up all its spectra before anything is shuffled.

#: Numbers that a task's sums may hold before it hands them on.
HELD = 1 << 22


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a list column one after another, and how many each row has; a null list has none."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float), sizes


def partial_sums(spectra: DataFrame, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """(keys, pos, mz, sum, max, n): one row a position of what each task has of each group of spectra of one length."""
    names = [*keys, "pos", "mz", "sum", "max", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for group, (mz, total, top, n) in held.items():
                many = len(total)
                columns = [pa.array([v] * many, t) for v, t in zip(group[:-1], types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(many, dtype=np.int32)), *map(pa.array, (mz, total, top)), pa.array(np.full(many, n))], names=names)
            held.clear()

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            (x, _), (y, sizes) = flat(batch.column("mzs")), flat(batch.column("ints"))
            at = np.concatenate(([0], np.cumsum(sizes)))
            groups: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), sizes.tolist(), strict=True)):
                groups.setdefault(group, []).append(i)
            for group, rows in groups.items():
                n = group[-1]
                block = y[at[rows][:, None] + np.arange(n)]
                mz, total, top, count = held.get(group) or (x[at[rows[0]] : at[rows[0]] + n].copy(), np.zeros(n), np.full(n, -np.inf), 0)
                held[group] = (mz, total + block.sum(axis=0), np.maximum(top, block.max(axis=0)), count + len(rows))
            if sum(len(h[1]) for h in held.values()) * 3 > HELD:
                yield from send()
        yield from send()

    kinds = ", ".join(f"{k} {spectra.schema[k].dataType.simpleString()}" for k in keys)
    return spectra.select(*keys, "mzs", "ints").mapInArrow(run, f"{kinds}, pos int, mz double, sum double, max double, n long")


def overview_shared_axis(spectra: DataFrame) -> DataFrame:
    """Sum, mean over all spectra and maximum (from 0, Q15) at each position of a shared axis."""
    out = partial_sums(spectra).groupBy("dataset_id", "pos").agg(F.min("mz").alias("mz"), F.sum("sum").alias("sum"), F.greatest(F.max("max"), F.lit(0.0)).alias("max"), F.sum("n").alias("hits"))
    return out.select("dataset_id", "pos", "mz", "sum", (F.col("sum") / F.col("hits")).alias("mean"), "max", "hits")


def overview_centroid_axis(spectra: DataFrame, norm: str = "tic") -> DataFrame:
    """The same for centroids on a shared axis: divided by the factor plus epsilon, nothing else."""
    factor = arrays.norm_factor(F.col("mzs"), F.col("ints"), norm, F.col("norm_infile")) + 2.220446049250313e-16
    return overview_shared_axis(spectra.withColumn("_f", factor).withColumn("ints", F.transform("ints", lambda a: a / F.col("_f"))))


def overview_binned(spectra: DataFrame, bins: int = 15000) -> DataFrame:
    """Bins between the least first and the greatest last mz: mean mz, sum, sum over hits, maximum of each that is hit.

    A task adds up all its samples by bin, whatever the spectrum; only sums of bins that are hit are shuffled.
    """
    ends = spectra.filter(F.size("mzs") > 0).groupBy("dataset_id").agg(F.min(F.get("mzs", F.lit(0))).alias("_lo"), F.max(F.element_at("mzs", -1)).alias("_hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def send() -> Iterator[pa.RecordBatch]:
            for dataset, (x, y, top, n) in held.items():
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([dataset] * len(hit), pa.string()), pa.array(hit), *(pa.array(v[hit]) for v in (x, y, top)), pa.array(n[hit])], names=["dataset_id", "bin", "x", "sum", "max", "n"])
            held.clear()

        for batch in batches:
            (x, sizes), (y, _) = flat(batch.column("mzs")), flat(batch.column("ints"))
            lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_lo", "_hi"))
            size = np.repeat((hi - lo) / bins, sizes)
            at = np.minimum(bins - 1, np.floor(np.divide(x - np.repeat(lo, sizes), size, out=np.zeros(len(x)), where=size > 0))).astype(np.int64)
            y = np.where(y < 10e-256, 0.0, y)
            names = batch.column("dataset_id").to_pylist()
            place = {d: i for i, d in enumerate(dict.fromkeys(names))}
            which = np.repeat(np.array([place[d] for d in names], np.int64), sizes)
            for dataset, i in place.items():
                mine = which == i if len(place) > 1 else slice(None)
                k, u, v = at[mine], x[mine], y[mine]
                sums = held.setdefault(dataset, (np.zeros(bins), np.zeros(bins), np.zeros(bins), np.zeros(bins, np.int64)))
                for into, w in ((sums[0], u), (sums[1], v), (sums[3], None)):
                    into += np.bincount(k, w, bins).astype(into.dtype)
                np.maximum.at(sums[2], k, v)
            if len(held) * bins * 4 > HELD:
                yield from send()
        yield from send()

    parts = spectra.select("dataset_id", "mzs", "ints").join(ends, "dataset_id").mapInArrow(run, "dataset_id string, bin long, x double, sum double, max double, n long")
    out = parts.groupBy("dataset_id", "bin").agg((F.sum("x") / F.sum("n")).alias("mz"), F.sum("sum").alias("sum"), F.max("max").alias("max"), F.sum("n").alias("hits"))
    return out.withColumn("mean", F.col("sum") / F.col("hits"))


def overview_stack(overviews: DataFrame, bins: int = 15000) -> DataFrame:
    """Overviews of slices binned anew: mean mz, mean of sums, mean of means, maximum."""
    ends = overviews.agg(F.min("mz").alias("_lo"), F.max("mz").alias("_hi"))
    size = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(size > 0, F.least(F.lit(bins - 1), F.floor((F.col("mz") - F.col("_lo")) / size))).otherwise(0)
    cut = overviews.join(F.broadcast(ends), F.lit(True)).withColumn("bin", at.cast("long"))  # ends is one row
    return cut.groupBy("bin").agg(F.avg("mz").alias("mz"), F.avg("sum").alias("sum"), F.avg("mean").alias("mean"), F.max("max").alias("max"), F.count(F.lit(1)).alias("hits"))


def region_spectra(spectra: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean, sum and maximum spectrum of each label above 0, added up in the tasks."""
    inside = spectra.select(*PIXEL, "mzs", "ints").join(labels.filter("label != 0").select(*PIXEL, "label"), PIXEL)
    out = partial_sums(inside, ("dataset_id", "label")).groupBy("dataset_id", "label", "pos")
    out = out.agg(F.min("mz").alias("mz"), F.sum("sum").alias("sum"), F.sum("n").alias("_n"), F.greatest(F.max("max"), F.lit(0.0)).alias("max"))
    return out.select("dataset_id", "label", "pos", "mz", "sum", (F.col("sum") / F.col("_n")).alias("mean"), "max")


def merge_accumulators(intervals: DataFrame, keys: list[str]) -> DataFrame:
    how = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
    return intervals.groupBy(*keys).agg(*[how[k](f"{a}_{k}").alias(f"{a}_{k}") for a in "xy" for k in how])


def masked_stats(pixels: DataFrame, keys: list[str], middle: bool = True) -> DataFrame:
    """Mean, population deviation, median (if asked for), minimum and maximum where label > 0; null where nothing is inside."""
    v = F.when(F.col("label") > 0, F.col("value"))
    stats = pixels.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    if not middle:
        return stats
    half = medians(pixels.filter("label > 0"), keys, "value")
    return stats.join(half, same(stats, half, keys), "left").select(*[stats[k] for k in keys], "mean", "std", "median", "min", "max")


def histogram(pixels: DataFrame, bins: int) -> DataFrame:
    """All bins between minimum and maximum, empty ones too; one bin if all values are equal."""
    ends = pixels.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    last = F.when(span > 0, F.lit(bins - 1)).otherwise(0)
    at = F.when(span > 0, F.floor((F.col("value") - F.col("_lo")) / span * (bins - 1))).otherwise(0)
    counts = pixels.select("value").join(F.broadcast(ends), F.lit(True)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = ends.filter("_lo is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("bin"), (F.col("_lo") + 0.0).alias("_lo"), span.alias("_span"))
    centre = F.when(F.col("_span") > 0, F.col("_lo") + (F.col("bin") + 0.5) * F.col("_span") / bins).otherwise(F.col("_lo"))
    return every.join(counts, "bin", "left").select("bin", centre.alias("centre"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def equidistant_bins(pts: DataFrame, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Bins of range / bins counted from 0, not from the least x: accumulators of each that is hit."""
    keys = keys or []
    ends = pts.groupBy(*keys).agg(((F.max("mz") - F.min("mz")) / bins).alias("_size"))
    cut = pts.join(ends, keys) if keys else pts.join(F.broadcast(ends), F.lit(True))  # one row a series
    return (
        cut.withColumn("bin", F.floor(F.col("mz") / F.col("_size")).cast("long"))
        .groupBy(*keys, "bin")
        .agg(F.avg("mz").alias("x_mean"), F.sum("intensity").alias("y_sum"), F.min("intensity").alias("y_min"), F.max("intensity").alias("y_max"), F.count(F.lit(1)).alias("n"))
    )


STRIDES = (1, 2, 4, 8, 16, 32, 64)


def level_of_detail(overview: DataFrame, n: int, wanted: float, visible: float) -> DataFrame:
    """Maxima of coarser and coarser bins, and of these levels the one whose density is nearest to wanted / visible."""
    levels = None
    for level, stride in enumerate(STRIDES):
        one = equidistant_bins(overview.select("mz", F.col("mean").alias("intensity")), max(1, n // stride)).select(F.lit(level).alias("level"), "x_mean", "y_max")
        levels = one if levels is None else levels.unionByName(one)
    sizes = levels.groupBy("level").agg((F.count(F.lit(1)) / (F.max("x_mean") - F.min("x_mean"))).alias("density"))
    best = sizes.agg(F.min_by("level", F.struct(F.abs(F.col("density") - wanted / visible), "level")).alias("level"))
    return levels.join(F.broadcast(best), "level")


def landmark_centroids(pixels: DataFrame) -> DataFrame:
    return pixels.filter("label != 0").groupBy("z", "label").agg(F.avg("wx").alias("wx"), F.avg("wy").alias("wy"), F.avg("wz").alias("wz"))


def normalize_series(series: DataFrame, keys: list[str], y: str) -> DataFrame:
    top = F.max(y).over(Window.partitionBy(*keys))
    return series.withColumn(y, F.when(top > 0, F.col(y) / top).otherwise(F.col(y)))
