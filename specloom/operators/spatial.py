"""Operators on images: scaling, neighbours, composites, masks and their components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.functions.scratch import Scratch
from specloom.functions.selection import medians
from specloom.operators.graph import components
from specloom.operators.images import PIXEL, masked_stats


def image_norm(pixels: DataFrame, kind: str, keys: tuple[str, ...] = ("dataset_id", "feature_id")) -> DataFrame:
    """Scale the values inside the mask (label > 0) by statistics of those; values outside stay.

    zscore, pareto, vast, minmax (0 / 0 is NaN), range, robust (median and MAD with the usual 1.4826, Q6).
    """
    keys = list(keys)
    stats = masked_stats(pixels, keys, middle=kind == "robust")
    if kind == "robust":
        distance = pixels.filter("label > 0").join(stats.select(*keys, F.col("median").alias("_m")), keys).withColumn("_d", F.abs(F.col("value") - F.col("_m")))
        stats = stats.join(medians(distance, keys, "_d", "_mad").select(*keys, (F.col("_mad") * 1.4826).alias("mad")), keys, "left")
    out = pixels.join(stats, keys)
    v, mean, std, lo, hi = (F.col(c) for c in ("value", "mean", "std", "min", "max"))
    nan = F.lit(float("nan"))
    span = hi - lo
    by = {
        "zscore": lambda: F.when(std == 0, v - mean).otherwise((v - mean) / std),
        "pareto": lambda: F.when(std == 0, v - mean).otherwise((v - mean) / F.sqrt(std)),
        "vast": lambda: F.when((std == 0) | (mean == 0), v - mean).otherwise((v - mean) / (std / mean)),
        "minmax": lambda: F.when(span == 0, nan).otherwise((v - lo) / span),
        "range": lambda: F.when(span == 0, nan).otherwise((v - mean) / span),
        "robust": lambda: F.when(F.col("mad") == 0, v - F.col("median")).otherwise((v - F.col("median")) / F.col("mad")),
    }[kind]()
    return out.select(*[c for c in pixels.columns if c != "value"], F.when(F.col("label") > 0, by).otherwise(v).alias("value"))


#: Pixels of a tile along x and y, and along z.
TILE, DEPTH = 256, 16


def by_tiles(df: DataFrame, keys: list[str], column: str, radius: int, axes: str, run: Callable, kind: str, tile: int = TILE) -> DataFrame:
    """(keys, x, y, z, column) of what `run` makes of tiles of each image: run(values, there) with arrays [z, y, x] of the tile and a
    rim of `radius` along the axes, cut at the image's edges, and of where they are in the image gives the tile's own values, masked where
    there are none. A pixel goes to its tile and to those whose rim it lies in, so rows grow by the rims alone.
    """
    ends = df.groupBy(*keys).agg(*[F.max(c).alias(f"_n{c}") for c in "xyz"])
    out = df.select(*keys, "x", "y", "z", F.col(column).alias("_v")).join(ends, keys)
    size, rim = {"x": tile, "y": tile, "z": DEPTH}, {c: radius if c in axes else 0 for c in "xyz"}
    for c in "xyz":
        low, high = F.greatest(F.col(c) - rim[c], F.lit(0)), F.least(F.col(c) + rim[c], F.col(f"_n{c}"))
        out = out.withColumn(f"_t{c}", F.explode(F.sequence(F.floor(low / size[c]), F.floor(high / size[c]))))

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        first, at, own, shape = frame.iloc[0], [], [], []
        for c in "zyx":
            n, a = int(first[f"_n{c}"]), int(first[f"_t{c}"]) * size[c]
            b = min(n, a + size[c] - 1)
            low, high = max(0, a - rim[c]), min(n, b + rim[c])
            at.append(frame[c].to_numpy() - low)
            own.append((low, a, b, high))
            shape.append(high - low + 1)
        values, there = np.zeros(shape), np.zeros(shape, bool)
        values[tuple(at)], there[tuple(at)] = frame["_v"].to_numpy(), True
        got = np.ma.asarray(run(values, there, own))
        kept = np.nonzero(~np.ma.getmaskarray(got))
        places = {c: kept[i] + own[i][1] for i, c in enumerate("zyx")}
        return pd.DataFrame({**{k: first[k] for k in keys}, **{c: places[c].astype(np.int32) for c in "xyz"}, column: got.data[kept]})

    names = {k: df.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join([*(f"{k} {t}" for k, t in names.items()), "x int, y int, z int", f"{column} {kind}"])
    return out.groupBy(*keys, "_tx", "_ty", "_tz").applyInPandas(each, schema)


def padded(values: np.ndarray, own: list[tuple[int, int, int, int]], rim: list[int]) -> np.ndarray:
    """The tile with its whole rim: beyond the image's edges, the edge again."""
    return np.pad(values, [(r - (a - low), r - (high - b)) for (low, a, b, high), r in zip(own, rim, strict=True)], mode="edge")


def smooth_median(pixels: DataFrame, keys: tuple[str, ...] = ("dataset_id", "feature_id"), axes: str = "xy", tile: int = TILE) -> DataFrame:
    """Median of the pixel and its neighbours at distance 1 along the axes, edge values repeated. Images are full rectangles."""
    rim = [int(c in axes) for c in "zyx"]

    def run(values: np.ndarray, there: np.ndarray, own: list) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(padded(values, own, rim), [2 * r + 1 for r in rim])
        return np.median(windows, axis=(-3, -2, -1))

    return by_tiles(pixels, list(keys), "value", 1, axes, run, "double", tile)


#: Discrete Gaussian weights exp(-t) I_k(t) of variance t = 0.66 ** 2 up to the radius that leaves an error under 0.01, scaled to sum 1.
def bessel_weights(variance: float = 0.66**2, error: float = 0.01) -> list[float]:
    def bessel(k: int) -> float:
        term = total = (variance / 2) ** k / float(np.prod(np.arange(1, k + 1))) if k else 1.0
        for m in range(1, 40):
            term *= (variance / 2) ** 2 / (m * (m + k))
            total += term
        return total * float(np.exp(-variance))

    weights = [bessel(0)]
    while weights[0] + 2 * sum(weights[1:]) < 1 - error:
        weights.append(bessel(len(weights)))
    whole = weights[0] + 2 * sum(weights[1:])
    return [w / whole for w in weights]


def smooth_gauss(pixels: DataFrame, keys: tuple[str, ...] = ("dataset_id", "feature_id"), axes: str = "xy", weights: list[float] | None = None, tile: int = TILE) -> DataFrame:
    """Separable discrete Gaussian, one weighted sum an axis, edge values repeated. Images are full rectangles."""
    weights = weights or bessel_weights()
    radius = len(weights) - 1
    rim = [radius * (c in axes) for c in "zyx"]

    def run(values: np.ndarray, there: np.ndarray, own: list) -> np.ndarray:
        out = padded(values, own, rim)
        for axis, r in enumerate(rim):
            n = out.shape[axis] - 2 * r
            if r:
                out = sum(weights[abs(d)] * np.take(out, np.arange(r + d, r + d + n), axis) for d in range(-r, r + 1))
        return out

    return by_tiles(pixels, list(keys), "value", radius, axes, run, "double", tile)


def windowed(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


def composite(pixels: DataFrame, layers: DataFrame, mode: str = "max") -> DataFrame:
    """One colour a pixel from several images: layers holds feature_id, low, high, r, g, b.

    Every image goes to [0, 1], each of a dataset and feature by itself, then its window to [0, 1]. max: the first image of the largest value colours the pixel,
    and `winner` is its place; mean: the mean of the images' colours. Colours run to 255.
    """
    ends = pixels.groupBy("dataset_id", "feature_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    places = layers.withColumn("_place", F.row_number().over(Window.orderBy("feature_id")))  # one row a colour that the user gives
    df = pixels.join(ends, ["dataset_id", "feature_id"]).join(places, "feature_id")
    unit = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    df = df.withColumn("_v", windowed(unit, F.col("low"), F.col("high")))
    if mode == "max":
        best = df.groupBy(*PIXEL).agg(F.max_by(F.struct("_v", "_place", "r", "g", "b"), F.struct("_v", -F.col("_place"))).alias("_b"))
        return best.select(*PIXEL, *[(F.col("_b._v") * F.col(f"_b.{c}") * 255).alias(c) for c in "rgb"], F.col("_b._place").alias("winner"))
    return df.groupBy(*PIXEL).agg(*[(F.avg(F.col("_v") * F.col(c)) * 255).alias(c) for c in "rgb"])


def ball(radius: int, flat: bool) -> list[tuple[int, int, int]]:
    """Offsets within radius + 1/2."""
    span = range(-radius, radius + 1)
    return [(x, y, z) for x in span for y in span for z in ([0] if flat else span) if x * x + y * y + z * z <= (radius + 0.5) ** 2]


def extents(mask: DataFrame) -> DataFrame:
    return mask.groupBy("dataset_id").agg(*[F.max(c).alias(f"_n{c}") for c in "xyz"])


def spread(on: np.ndarray, own: list, radius: int, flat: bool) -> np.ndarray:
    """Of a tile with its rim, the own pixels with an `on` pixel in their ball; beyond the image none is."""
    rim = [0 if flat else radius, radius, radius]
    wide = np.pad(on, [(r - (a - low), r - (high - b)) for (low, a, b, high), r in zip(own, rim, strict=True)])
    size = [n - 2 * r for n, r in zip(wide.shape, rim, strict=True)]
    out = np.zeros(size, bool)
    for step in ball(radius, flat):
        start = [r + d for r, d in zip(rim, step[::-1], strict=True)]
        out |= wide[tuple(slice(a, a + n) for a, n in zip(start, size, strict=True))]
    return out


def core(values: np.ndarray, own: list) -> np.ndarray:
    return values[tuple(slice(a - low, b - low + 1) for low, a, b, _ in own)]


def mask_dilate(mask: DataFrame, radius: int, flat: bool = True, tile: int = TILE) -> DataFrame:
    """Foreground pixels (label != 0) of the dilated mask, by tiles; mask holds every pixel of the image."""

    def run(values: np.ndarray, there: np.ndarray, own: list) -> np.ndarray:
        grown = spread(values != 0, own, radius, flat)
        return np.ma.array(grown, mask=~grown)

    return by_tiles(mask, ["dataset_id"], "label", radius, "xy" if flat else "xyz", run, "boolean", tile).select(PIXEL)


def mask_erode(mask: DataFrame, radius: int, flat: bool = True, tile: int = TILE) -> DataFrame:
    """Foreground pixels whose whole ball is foreground, by tiles; outside of the image counts as foreground."""

    def run(values: np.ndarray, there: np.ndarray, own: list) -> np.ndarray:
        stays = core(there & (values != 0), own) & ~spread(there & (values == 0), own, radius, flat)
        return np.ma.array(stays, mask=~stays)

    return by_tiles(mask, ["dataset_id"], "label", radius, "xy" if flat else "xyz", run, "boolean", tile).select(PIXEL)


def as_mask(foreground: DataFrame, mask: DataFrame) -> DataFrame:
    """The full mask with label 1 on the given pixels."""
    return mask.select(PIXEL).join(foreground.select(*PIXEL, F.lit(1).alias("_on")), PIXEL, "left").select(*PIXEL, F.coalesce("_on", F.lit(0)).alias("label"))


def mask_close(mask: DataFrame, radius: int, flat: bool = True) -> DataFrame:
    return mask_erode(as_mask(mask_dilate(mask, radius, flat), mask), radius, flat)


def label_tiles(mask: DataFrame, full: bool, tile: int) -> DataFrame:
    """(pixel, node): components within each tile, named by their least pixel number; no tile knows of another."""
    near = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) < (0, 0, 0) and (full or abs(x) + abs(y) + abs(z) == 1)]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["z", "y", "x"], kind="stable").reset_index(drop=True)
        x, y, z, ids = (frame[c].to_numpy(np.int64) for c in ("x", "y", "z", "pixel"))
        row = (z << 21 | y) << 21  # rows of pixels, and runs of neighbours in them
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (x[1:] != x[:-1] + 1)))
        length = np.diff(np.append(first, len(x)))
        low, high = row[first] + x[first], row[first] + x[first] + length - 1
        root, links = np.arange(len(first)), []
        for dy, dz in sorted({(dy, dz) for _, dy, dz in near if (dy, dz) != (0, 0)}):
            reach = max(abs(dx) for dx, v, w in near if (v, w) == (dy, dz))
            to = (dz << 42) + (dy << 21)
            a, b = np.searchsorted(high, low + to - reach), np.searchsorted(low, high + to + reach, side="right")
            n = np.maximum(b - a, 0)
            mine = np.repeat(np.arange(len(first)), n)
            links.append((mine, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)))
        u, v = (np.concatenate([pair[i] for pair in links]) for i in (0, 1))
        while (root[u] != root[v]).any():  # the lower root of each link, then roots of roots
            low_root = np.minimum(root[u], root[v])
            for end in (u, v):
                np.minimum.at(root, root[end], low_root)
            while (root[root] != root).any():
                root = root[root]
        frame["node"] = ids[first[np.repeat(root, length)]]
        return frame.drop(columns=["_tx", "_ty"])

    on = mask.filter("label != 0").select(*PIXEL, pixel_number().alias("pixel"), F.floor(F.col("x") / tile).alias("_tx"), F.floor(F.col("y") / tile).alias("_ty"))
    return on.groupBy("dataset_id", "_tx", "_ty").applyInPandas(run, "dataset_id string, x int, y int, z int, pixel long, node long")


def pixel_number() -> Column:
    """z, y, x in one number, so that the least is the first pixel in that order."""
    return (F.col("z").cast("long") * 1048576 + F.col("y")) * 1048576 + F.col("x")


def connected_components(mask: DataFrame, full: bool = False, tile: int = 256, keep: int | None = None) -> DataFrame:
    """Pixel, label and size of the components of each dataset's foreground; labels 1 to N by falling size, then first pixel.

    Tiles are labelled each by itself (their size bounds the memory), then the pairs of labels that touch across tile
    edges are merged as a graph. All components stay, unless `keep` says how many labels there may be (65535 fit 16 bits).
    """
    scratch = Scratch(mask.sparkSession, "components")
    tiles = scratch.keep(label_tiles(mask, full, tile), "tiles")
    edge = tiles.filter(" or ".join(f"({c} % {tile}) in (0, {tile - 1})" for c in "xy"))
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0) and (full or abs(x) + abs(y) + abs(z) == 1)]
    array = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", s, strict=True)]) for s in steps])
    seen = edge.select("dataset_id", *PIXEL[1:], "node", F.explode(array).alias("_s")).select("dataset_id", *[(F.col(c) + F.col(f"_s.{c}")).alias(c) for c in "xyz"], F.col("node").alias("_a"))
    # a dataset's number joins the pixel's, so that no two datasets share a node
    touching = seen.join(edge.select(*PIXEL, F.col("node").alias("_b")), PIXEL).filter("_a != _b").select("dataset_id", "_a", "_b").distinct()
    ids = scratch.keep(tiles.select("dataset_id").distinct().withColumn("_d", F.row_number().over(Window.orderBy("dataset_id")).cast("long")), "datasets")
    wide = F.lit(1 << 50)
    named = lambda df, *cols: df.join(ids, "dataset_id").select("*", *[(F.col("_d") * wide + F.col(c)).alias(f"{c}_") for c in cols])
    roots = components(named(touching, "_a", "_b"), "_a_", "_b_", "components-graph")
    merged = named(tiles, "node").join(roots.withColumnRenamed("node", "node_"), "node_", "left").withColumn("root", F.coalesce("root", "node_"))
    sizes = merged.groupBy("dataset_id", "root").agg(F.count(F.lit(1)).alias("size"), F.min("pixel").alias("_first"))
    ranked = sizes.withColumn("label", F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("size"), "_first")))
    if keep is not None:
        ranked = ranked.filter(F.col("label") <= keep)
    return merged.join(ranked, ["dataset_id", "root"]).select(*PIXEL, F.col("label").cast("int").alias("label"), "size")


def fill_holes(mask: DataFrame, tile: int = 256) -> DataFrame:
    """The full mask with background regions that don't reach the border turned to foreground; flat images use their 2-D border."""
    background = connected_components(mask.withColumn("label", (F.col("label") == 0).cast("int")), False, tile, 2**31 - 1)
    ends = extents(mask)
    border = "x in (0, _nx) or y in (0, _ny) or (_nz > 0 and z in (0, _nz))"
    outside = background.join(ends, "dataset_id").filter(border).select("dataset_id", "label").distinct()
    holes = background.join(outside, ["dataset_id", "label"], "left_anti").select(PIXEL)
    return as_mask(mask.filter("label != 0").select(PIXEL).unionByName(holes), mask)


def suggest_groups(sizes: DataFrame) -> DataFrame:
    """Three ranges of equal width over the sizes: low and high by whole division (Q8)."""
    ends = sizes.agg(F.min("size").alias("_lo"), F.max("size").alias("_hi"))
    cut = lambda i: f"_lo + (_hi - _lo) * {i} div 3"
    one = [F.struct(F.lit(i + 1).alias("group"), F.expr(cut(i)).alias("low"), F.expr(cut(i + 1) + (" - 1" if i < 2 else "")).alias("high")) for i in range(3)]
    return ends.filter("_lo is not null").select(F.explode(F.array(*one)).alias("g")).select("g.*")


def assign_groups(sizes: DataFrame, groups: DataFrame, match: str = "last") -> DataFrame:
    """The group of each component whose inclusive range holds its size: the last that matches, or the first (Q8); 0 without any.

    groups is a short list given by the user.
    """
    held = sizes.join(F.broadcast(groups), F.col("size").between(F.col("low"), F.col("high")), "left")
    pick = F.max("group") if match == "last" else F.min("group")
    return held.groupBy(*sizes.columns).agg(F.coalesce(pick, F.lit(0)).alias("group"))


def export_pixelwise(world: DataFrame, clusters: DataFrame, features: DataFrame) -> DataFrame:
    """World position, cluster, group and features of every pixel; features outside any spectrum are NaN.

    features: wide form, one column a feature, keyed by pixel.
    """
    names = [c for c in features.columns if c not in PIXEL and c != "spectrum_id"]
    out = world.join(clusters, PIXEL, "left").join(features.select(*PIXEL, *names), PIXEL, "left")
    return out.select("wx", "wy", "wz", F.coalesce("label", F.lit(0)).alias("cluster"), F.coalesce("group", F.lit(0)).alias("group"), *[F.coalesce(F.col(f"`{n}`"), F.lit(float("nan"))).alias(n) for n in names])


def export_objectwise(pixelwise: DataFrame) -> DataFrame:
    """One row a cluster: mean position, size, group and mean of each feature without its NaNs."""
    names = [c for c in pixelwise.columns if c not in ("wx", "wy", "wz", "cluster", "group")]
    return pixelwise.filter("cluster > 0").groupBy("cluster").agg(
        *[F.avg(c).alias(c) for c in ("wx", "wy", "wz")], F.count(F.lit(1)).alias("size"), F.max("group").alias("group"), *[F.avg(F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`"))).alias(n) for n in names]
    )
