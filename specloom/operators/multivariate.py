"""Clustering and projection of pixels. The matrix is wide: keys, then one double column a feature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions.scratch import Scratch

KEYS = ["dataset_id", "spectrum_id", "x", "y", "z"]
#: Rows of sums that the driver adds up itself.
ROWS_TO_DRIVER = 64


def features(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in KEYS and c != "label"]


def minmax_columns(matrix: DataFrame) -> DataFrame:
    """Every feature to [0, 1] over all images; a constant one is 0."""
    names = features(matrix)
    ends = matrix.agg(*[F.min(c).alias(f"_lo_{c}") for c in names], *[F.max(c).alias(f"_hi_{c}") for c in names])
    out = matrix.join(F.broadcast(ends), F.lit(True))  # one row
    span = {c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}") for c in names}
    kept = [c for c in matrix.columns if c not in names]
    return out.select(*kept, *[F.when(span[c] > 0, (F.col(c) - F.col(f"_lo_{c}")) / span[c]).otherwise(0.0).alias(c) for c in names])


def standardize_columns(matrix: DataFrame) -> DataFrame:
    """Every feature less its mean over the sample deviation (a constant one is 0)."""
    names = features(matrix)
    ends = matrix.agg(*[F.avg(c).alias(f"_m_{c}") for c in names], *[F.stddev_samp(c).alias(f"_s_{c}") for c in names])
    out = matrix.join(F.broadcast(ends), F.lit(True))  # one row
    kept = [c for c in matrix.columns if c not in names]
    return out.select(*kept, *[F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0).alias(c) for c in names])


def distances(rows: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """Euclidean, or 1 minus cosine, or 1 minus Pearson correlation."""
    if metric == "euclid":
        return np.sqrt(np.maximum(0, (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None]))
    if metric == "pearson":
        rows, centres = rows - rows.mean(1, keepdims=True), centres - centres.mean(1, keepdims=True)
    norm = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(centres, axis=1)[None]
    return 1 - np.divide(rows @ centres.T, norm, out=np.zeros(norm.shape), where=norm > 0)


def kmeans(matrix: DataFrame, k: int, metric: str = "euclid", spatial_weight: float = 0.0, rounds: int = 100, seed: int = 0, start: np.ndarray | None = None) -> DataFrame:
    """Label 1 to k of each pixel. In a round a task adds up all its rows to k sums; 64 rows of such sums come to the driver at most.

    Features go to [0, 1] first; positions scaled to [0, 1] and by 2 * spatial_weight join them. Starts are the k rows of
    least seeded hash (Q13), or the rows given. The first of equal distances wins; an empty cluster keeps its centre.
    """
    names = features(matrix)
    scaled = minmax_columns(matrix)
    if spatial_weight:
        ends = matrix.agg(*[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
        scaled = scaled.join(F.broadcast(ends), F.lit(True))  # one row
        places = [F.when(F.col(f"_hi{c}") > F.col(f"_lo{c}"), (F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}"))).otherwise(0.0) * 2 * spatial_weight for c in "xyz"]
    else:
        places = []
    rows = Scratch(matrix.sparkSession, "kmeans").keep(scaled.select(*KEYS, F.array(*names, *places).alias("v")), "rows")
    if start is None:
        first = rows.orderBy(F.xxhash64(F.lit(seed), "dataset_id", "spectrum_id"), "dataset_id", "spectrum_id").limit(k).collect()
        start = np.array([r["v"] for r in first])
    centres = np.asarray(start, float)

    width = len(centres[0]) if len(centres) else 0
    added = "n array<long>, s array<double>"

    def packed(n: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"n": [n], "s": [s.ravel()]})

    def sums(centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
            for batch in batches:
                block = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                near = distances(block, centres, metric).argmin(axis=1)
                n += np.bincount(near, minlength=len(n))
                s += np.eye(len(n))[near].T @ block
            yield pa.RecordBatch.from_pandas(packed(n, s), preserve_index=False)

        return run

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(len(centres), np.int64), np.zeros(centres.size)
        for frame in frames:
            n, s = n + np.sum(frame["n"].to_list(), axis=0), s + np.sum(frame["s"].to_list(), axis=0)
        yield packed(n, s)

    held = rows.select("v").persist()  # lost blocks are read again from the written table
    for _ in range(rounds if width else 0):
        parts = held.mapInArrow(sums(centres), added)
        if held.rdd.getNumPartitions() > ROWS_TO_DRIVER:
            parts = parts.repartition(ROWS_TO_DRIVER).mapInPandas(again, added)
        found = parts.collect()
        n, s = (np.sum([r[i] for r in found], axis=0) for i in (0, 1))
        new = np.where(n[:, None] > 0, s.reshape(centres.shape) / np.maximum(n, 1)[:, None], centres)
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    held.unpersist()

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = distances(np.stack(frame["v"].to_list()), centres, metric).argmin(axis=1) + 1
            yield frame[KEYS].assign(label=near.astype(np.int32))

    return rows.mapInPandas(label, "dataset_id string, spectrum_id long, x int, y int, z int, label int")


def pca(matrix: DataFrame, n: int, centre: str = "row") -> tuple[DataFrame, np.ndarray]:
    """Scores (first n left singular vectors) and loadings (V times singular values) of the matrix less each pixel's mean over its features.

    centre="column" takes off the features' means instead. The features' products are summed up, a row a task and eight rows to the driver, to one
    d by d matrix (Q14: zero background rows add nothing), which is taken apart on the driver. Signs: the
    largest loading of each component is positive. Row centring leaves d - 1 components at most.
    """
    names = features(matrix)
    d = len(names)
    if d < 3:
        raise ValueError("at least three features are needed")
    if centre == "column":
        means = list(matrix.agg(*[F.avg(c) for c in names]).first())
        moved = matrix.select(*KEYS, F.array(*[F.col(c) - m for c, m in zip(names, means, strict=True)]).alias("v"))
    else:
        mean = sum((F.col(c) for c in names), F.lit(0.0)) / d
        moved = matrix.withColumn("_m", mean).select(*KEYS, F.array(*[F.col(c) - F.col("_m") for c in names]).alias("v"))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            block = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            total += block.T @ block
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d * d)
        for frame in frames:
            total += np.sum(frame["g"].to_list(), axis=0)
        yield pd.DataFrame({"g": [total]})

    # a row a task, then a few rows of sums
    parts = moved.select("v").mapInArrow(gram, "g array<double>").repartition(8).mapInPandas(added, "g array<double>")
    total = np.sum([r["g"] for r in parts.collect()], axis=0).reshape(d, d)
    values, vectors = np.linalg.eigh((total + total.T) / 2)
    top = np.argsort(values)[::-1][: min(n, d - (centre == "row"))]
    s, v = np.sqrt(np.maximum(values[top], 0)), vectors[:, top]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    project = np.divide(v, s, out=np.zeros_like(v), where=s > 1e-12)
    dots = [F.aggregate(F.zip_with("v", F.array(*map(F.lit, project[:, i].tolist())), lambda a, b: a * b), F.lit(0.0), lambda acc, p: acc + p).alias(f"pc{i + 1}") for i in range(len(top))]
    return moved.select(*KEYS, *dots), v * s


def embed_to_rgb(components: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Three components to 0 ... 255 by their minima and maxima."""
    ends = components.agg(*[F.min(c).alias(f"_lo{c}") for c in names], *[F.max(c).alias(f"_hi{c}") for c in names])
    out = components.join(F.broadcast(ends), F.lit(True))  # one row
    return out.select(*KEYS, *[F.when(F.col(f"_hi{c}") > F.col(f"_lo{c}"), (F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * 255).otherwise(0.0).alias(t) for c, t in zip(names, "rgb", strict=True)])
