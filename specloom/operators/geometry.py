"""Positions: tiles, world coordinates, moving and arranging datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def crop_to_min_area(spectra: DataFrame) -> DataFrame:
    """Indices from 0 and the size of each dataset in nx, ny, nz."""
    ends = spectra.groupBy("dataset_id").agg(*[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    out = spectra.join(ends, "dataset_id")
    moved = {c: F.col(c) - F.col(f"_lo{c}") for c in "xyz"} | {f"n{c}": F.col(f"_hi{c}") - F.col(f"_lo{c}") + 1 for c in "xyz"}
    return out.withColumns(moved).drop(*[f"_{n}{c}" for c in "xyz" for n in ("lo", "hi")])


def z_from_world(spectra: DataFrame) -> DataFrame:
    """Dense slice number of the whole part of wz in z, and the distance of the first two slices in `spacing`.

    Slices are ranked on their distinct values, of which there are few, and joined back.
    """
    whole = F.col("wz").cast("int")
    slices = spectra.select("dataset_id", whole.alias("_w")).distinct()
    ranked = slices.withColumn("z", F.row_number().over(Window.partitionBy("dataset_id").orderBy("_w")) - 1)
    spacing = ranked.groupBy("dataset_id").agg((F.max(F.when(F.col("z") == 1, F.col("_w"))) - F.max(F.when(F.col("z") == 0, F.col("_w")))).alias("spacing"))
    return spectra.drop("z").withColumn("_w", whole).join(ranked, ["dataset_id", "_w"]).join(spacing, "dataset_id").drop("_w")


def pixel_size(meta: DataFrame) -> DataFrame:
    """sx, sy, sz in mm from micrometres: a lone positive size_x is an area; 50 without any, 10 for z."""
    alone = (F.col("size_x") > 0) & (F.coalesce("size_y", F.lit(-1.0)) < 0)
    both = (F.col("size_x") > 0) & (F.col("size_y") > 0)
    side = lambda c: F.when(alone, F.sqrt("size_x")).when(both, F.col(c)).otherwise(50.0) / 1000
    return meta.withColumns({"sx": side("size_x"), "sy": side("size_y"), "sz": F.coalesce("size_z", F.lit(10.0)) / 1000})


def spectrum_format(meta: DataFrame) -> DataFrame:
    """`format` and `type`, filled in: continuous; centroid if processed, else profile."""
    mode = F.coalesce("mode", F.lit("continuous"))
    kind = F.coalesce("kind", F.when(mode == "processed", "centroid").otherwise("profile"))
    return meta.withColumns({"format": mode, "type": kind})


def tile(pixels: DataFrame, width: int = 8192, height: int = 8192, spacing: tuple[float, float] = (1.0, 1.0), origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Tile of each pixel, its place within, and the tile's origin; tiles at the far edges are smaller."""
    tx, ty = F.floor(F.col("x") / width).cast("int"), F.floor(F.col("y") / height).cast("int")
    return pixels.withColumns(
        {"tile_x": tx, "tile_y": ty, "in_x": F.col("x") % width, "in_y": F.col("y") % height, "origin_x": origin[0] + tx * width * spacing[0], "origin_y": origin[1] + ty * height * spacing[1]}
    )


def index_to_world(df: DataFrame, origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0), direction=((1, 0, 0), (0, 1, 0), (0, 0, 1))) -> DataFrame:
    step = [F.col(c) * s for c, s in zip("xyz", spacing, strict=True)]
    return df.withColumns({f"w{c}": sum((d * s for d, s in zip(direction[i], step, strict=True)), F.lit(origin[i])) for i, c in enumerate("xyz")})


def move(geometry: DataFrame, dx: float, dy: float, dz: float = 0.0) -> DataFrame:
    return geometry.withColumns({f"o{c}": F.col(f"o{c}") + d for c, d in zip("xyz", (dx, dy, dz), strict=True)})


def mirror(geometry: DataFrame, axis: str) -> DataFrame:
    """Flip along x or y in place: the origin goes to the far side, the spacing's sign turns."""
    return geometry.withColumns({f"o{axis}": F.col(f"o{axis}") + F.col(f"s{axis}") * (F.col(f"n{axis}") - 1), f"s{axis}": -F.col(f"s{axis}")})


def rotate(geometry: DataFrame, degrees: float, shared: bool = False) -> DataFrame:
    """Turn about z around each dataset's own centre, or around the mean of all centres; `angle` adds up."""
    centre = {c: F.col(f"o{c}") + F.col(f"s{c}") * (F.col(f"n{c}") - 1) / 2 for c in "xy"}
    out = geometry.withColumns({f"_c{c}": v for c, v in centre.items()})
    if shared:
        means = out.agg(*[F.avg(f"_c{c}").alias(f"_c{c}") for c in "xy"])
        out = out.drop("_cx", "_cy").join(F.broadcast(means), F.lit(True))  # one row
    a = F.radians(F.lit(degrees))
    dx, dy = F.col("ox") - F.col("_cx"), F.col("oy") - F.col("_cy")
    return out.withColumns({"ox": F.col("_cx") + dx * F.cos(a) - dy * F.sin(a), "oy": F.col("_cy") + dx * F.sin(a) + dy * F.cos(a), "angle": F.coalesce("angle", F.lit(0.0)) + degrees}).drop("_cx", "_cy")


def mosaic(geometry: DataFrame, rows: int) -> DataFrame:
    """Datasets by name in rows of ceil(n / rows): origin of each cell, cells as large as the largest dataset in own pixels."""
    out = geometry.withColumn("_i", F.row_number().over(Window.orderBy("dataset_id")) - 1)  # one row a dataset
    ends = geometry.agg(F.ceil(F.count(F.lit(1)) / rows).alias("_per"), F.max("nx").alias("_w"), F.max("ny").alias("_h"))
    out = out.join(F.broadcast(ends), F.lit(True))
    return out.withColumns({"ox": (F.col("_i") % F.col("_per")) * F.col("_w") * F.col("sx"), "oy": F.floor(F.col("_i") / F.col("_per")) * F.col("_h") * F.col("sy")}).drop("_i", "_per", "_w", "_h")


def align_centres(geometry: DataFrame) -> DataFrame:
    """The dataset of the longest diagonal goes to 0, the others to the same centre."""
    half = {c: F.col(f"s{c}") * F.col(f"n{c}") / 2 for c in "xy"}
    diagonal = F.sqrt(F.pow(2 * half["x"], 2) + F.pow(2 * half["y"], 2))
    lead = geometry.agg(F.max_by(F.struct(half["x"].alias("x"), half["y"].alias("y")), F.struct(diagonal, "dataset_id")).alias("_lead"))
    out = geometry.join(F.broadcast(lead), F.lit(True))  # one row
    return out.withColumns({f"o{c}": F.col(f"_lead.{c}") - half[c] for c in "xy"}).drop("_lead")


def rescale(pixels: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """NaN and infinities as 0, then the image's range to [low, high]; a flat image becomes low."""
    v = F.col("value")
    clean = pixels.withColumn("value", F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))
    ends = clean.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    out = clean.join(ends, keys)
    span = F.col("_hi") - F.col("_lo")
    return out.withColumn("value", F.when(span > 0, low + (v - F.col("_lo")) / span * (high - low)).otherwise(low)).drop("_lo", "_hi")


def select_component(pixels: DataFrame, feature_id: int) -> DataFrame:
    return pixels.filter(F.col("feature_id") == feature_id)


def shrink(pixels: DataFrame, factor: int) -> DataFrame:
    """Every factor-th pixel along x and y, counted from the middle of the first block."""
    half = factor // 2
    return pixels.filter((F.col("x") % factor == half) & (F.col("y") % factor == half)).withColumns({"x": F.floor(F.col("x") / factor).cast("int"), "y": F.floor(F.col("y") / factor).cast("int")})


def landmark_error(points: DataFrame, per_layer: int) -> DataFrame:
    """Distance of each point to the same point of the next layer: mean of each point's, then mean and population deviation of those.

    Points are numbered layer by layer, so the next layer's point is `per_layer` ids on: an equi-join.
    """
    ahead = points.select((F.col("point_id") - per_layer).alias("point_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    steps = points.join(ahead, "point_id").withColumn("_d", F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)))
    means = steps.groupBy((F.col("point_id") % per_layer).alias("landmark")).agg(F.avg("_d").alias("_m"))
    return means.agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("std"))


def stack(parts: list[DataFrame], axis: str, pixel_sizes: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """Datasets side by side along x, y or z, each after the extent of those before.

    Where they hold spectra, all of these must have one axis; given pixel sizes must agree to 1e-4.
    """
    for size in pixel_sizes or []:
        if any(abs(a - b) > 1e-4 for a, b in zip(size, pixel_sizes[0], strict=True)):
            raise ValueError(f"pixel sizes differ: {pixel_sizes}")
    out, shift, axes = None, 0, set()
    for part in parts:
        hashes = [f(F.xxhash64("mzs")) for f in (F.min, F.max)] if "mzs" in part.columns else []
        extent, *found = part.agg(F.max(axis), *hashes).first()
        axes |= {h for h in found if h is not None}
        if len(axes) > 1:
            raise ValueError("the datasets' spectra differ in their axes")
        part = part.withColumn(axis, (F.col(axis) + shift).cast(part.schema[axis].dataType))
        out = part if out is None else out.unionByName(part)
        shift += 0 if extent is None else extent + 1
    return out


def merge_peak_lists(lists: list[DataFrame]) -> DataFrame:
    """The intervals of stacked datasets as one list by x mean; of equal x means the first list's, of least interval_id, stays."""
    out = None
    for i, one in enumerate(lists):
        one = one.select(F.struct(*one.columns).alias("_row"), "x_mean", F.struct(F.lit(i).alias("i"), "interval_id").alias("_at"))
        out = one if out is None else out.union(one)
    return out.groupBy("x_mean").agg(F.min_by("_row", "_at").alias("_row")).select("_row.*").orderBy("x_mean")


def stack_slices(parts: list[DataFrame]) -> DataFrame:
    """One z a dataset. Slices must have the same extent in x and y, and one format where they name it."""
    named = all("format" in p.columns for p in parts)
    found = [tuple(p.agg(F.max("x"), F.max("y"), *[f("format") for f in (F.min, F.max) if named]).first()) for p in parts]
    if len(sizes := {f[:2] for f in found}) > 1:
        raise ValueError(f"slices differ in size: {sorted(sizes)}")
    if len(formats := {v for f in found for v in f[2:]}) > 1:
        raise ValueError(f"slices differ in format: {sorted(map(str, formats))}")
    out = None
    for z, part in enumerate(parts):
        part = part.withColumn("z", F.lit(z))
        out = part if out is None else out.unionByName(part)
    return out
