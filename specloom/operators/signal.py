"""Per-spectrum processing: one Arrow pass, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import arrays, kernels


def by_length(values: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length as one block, with their positions."""
    sizes = values.map(len).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.stack(values.iloc[at].to_list()).astype(float) if n else np.zeros((len(at), 0))


def on_arrays(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A kernel over blocks as a column function over array<double>."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        out = np.empty(len(values), object)
        for at, block in by_length(values):
            for i, row in zip(at, kernel(block), strict=True):
                out[i] = row
        return pd.Series(out)

    return run


def on_arrays_with_axis(kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    """The same with the axis of each spectrum; equal axes share one block."""

    @F.pandas_udf("array<double>")
    def run(axes: pd.Series, values: pd.Series) -> pd.Series:
        out = np.empty(len(values), object)
        groups: dict[bytes, list[int]] = {}
        for i, axis in enumerate(axes):
            groups.setdefault(np.asarray(axis, float).tobytes(), []).append(i)
        for axis, at in groups.items():
            block = np.stack(values.iloc[at].to_list()).astype(float)
            for i, row in zip(at, kernel(block, np.frombuffer(axis)), strict=True):
                out[i] = row
        return pd.Series(out)

    return run


def smooth(ints: Column, kind: str, hws: int) -> Column:
    return on_arrays(lambda b: kernels.smooth(b, kind, hws))(ints)


def baseline(ints: Column, kind: str, hws: int) -> Column:
    return on_arrays(lambda b: kernels.baseline(b, kind, hws))(ints)


def erode(ints: Column, hws: int) -> Column:
    return on_arrays(lambda b: kernels.erode(b, hws))(ints)


def dilate(ints: Column, hws: int) -> Column:
    return on_arrays(lambda b: kernels.dilate(b, hws))(ints)


def derivative(ints: Column, order: int = 1, hws: int = 5, degree: int = 4) -> Column:
    return on_arrays(lambda b: kernels.derivative(b, order, hws, degree))(ints)


def bridge_bands(mzs: Column, ints: Column, bands=kernels.BANDS) -> Column:
    return on_arrays_with_axis(lambda b, x: kernels.bridge_bands(b, x, bands))(mzs, ints)


def scatter_correct(mzs: Column, ints: Column, degree: int = 2) -> Column:
    return on_arrays_with_axis(lambda b, x: kernels.scatter_correct(b, x, degree))(mzs, ints)


def process(spectra: DataFrame, norm: str = "none", smoothing: tuple[str, int] = ("none", 0), base: tuple[str, int] = ("none", 0), transform: str = "none", external: Column | None = None) -> DataFrame:
    """Divide by the factor, smooth, take off the baseline, transform, always in this order.

    With a kernel, all of it is one Arrow pass; without any, nothing leaves the JVM. The factor is not guarded (Q17). Arrays and factor are
    computed once a spectrum: as plain expressions Spark puts them into the lambdas, where the time grows with the cube of the samples.
    """
    if smoothing[0] == "none" and base[0] == "none":
        factor = lambda s: arrays.norm_factor(s["mzs"], s["ints"], norm, F.col("norm_infile"), external)
        divided = lambda s: arrays.once(factor(s), lambda f: F.transform(s["ints"], lambda a: a / f))
        out = spectra if norm == "none" else spectra.withColumn("ints", arrays.once(F.struct("mzs", "ints"), divided))
        return out.withColumn("ints", arrays.transform_intensity(F.col("ints"), transform))
    given = norm in ("internal", "external")  # a factor beside the spectrum
    side = {"internal": F.col("norm_infile"), "external": external}.get(norm, F.lit(1.0))

    @F.pandas_udf("array<double>")
    def run(axes: pd.Series, values: pd.Series, sides: pd.Series) -> pd.Series:
        out = np.empty(len(values), object)
        sides = sides.fillna(1.0).to_numpy(float)
        for at, block in by_length(values):
            factors = sides[at] if given else kernels.norm_factors(np.stack(axes.iloc[at].to_list()) if norm == "tic" else None, block, norm)
            with np.errstate(divide="ignore", invalid="ignore"):
                block = block / factors[:, None]
            done = kernels.baseline(kernels.smooth(block, *smoothing), *base)
            for i, row in zip(at, kernels.transformed(done, transform), strict=True):
                out[i] = row
        return pd.Series(out)

    return spectra.withColumn("ints", run("mzs", "ints", side.cast("double")))


def mir_process(spectra: DataFrame, to_transmittance: bool = True, l2: bool = True, order: int = 0) -> DataFrame:
    """Infrared chain: transmittance, then unit length, then a derivative."""
    ints = F.col("ints")
    out = spectra.withColumn("ints", arrays.transmittance(ints)) if to_transmittance else spectra
    out = out.withColumn("ints", arrays.vector_normalize(ints)) if l2 else out
    return out.withColumn("ints", derivative(ints, order)) if order else out
