"""Queries over spectra: factors, kernels, pooling, overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.functions import arrays, kernels
from specloom.operators import images, shift, signal, spatial
from specloom.plans.fixtures import CENTROIDS, CUBE, IMAGE, centroid_spectra, cube, image, lineitem_peaks, mask, read, targets
from specloom.plans.registry import query, r, rounded

TIC = "tic AS (SELECT spectrum_id, sum((intensity + prev) * 0.25) AS f FROM (SELECT *, lag(intensity) OVER (PARTITION BY spectrum_id ORDER BY pos) AS prev FROM pts) GROUP BY 1)"


@query(f"""WITH {CUBE}, {TIC},
pool AS (SELECT spectrum_id, x, y, label, avg(intensity / f) AS v FROM pts JOIN tic USING (spectrum_id) WHERE mz BETWEEN 409 AND 411 GROUP BY ALL),
s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM pool WHERE label > 0)
SELECT spectrum_id, x, y, round(CASE WHEN label > 0 THEN (v - m) / d ELSE v END, 6) + 0.0 AS value FROM pool, s""")
def ion_image(spark, sf_dir):
    df = signal.process(cube(spark, sf_dir), norm="tic")
    pixels = images.ion_image(df, 410.0, 1.0).withColumn("feature_id", F.lit(1)).join(mask(spark, sf_dir), images.PIXEL)
    return spatial.image_norm(pixels, "zscore").select("spectrum_id", "x", "y", r("value").alias("value"))


@query(f"""WITH {CUBE}, {TIC}
SELECT p.spectrum_id, round(any_value(f), 6) AS tic, round(sum(intensity), 6) AS sum, round(avg(intensity), 6) AS mean, round(max(intensity), 6) AS max,
  round(sqrt(avg(intensity * intensity)), 6) AS rms, any_value(norm_infile) AS internal, 1.0::DOUBLE AS "none" FROM pts p JOIN tic USING (spectrum_id) GROUP BY 1""")
def norm_factors(spark, sf_dir):
    df = cube(spark, sf_dir)
    factor = lambda k: arrays.norm_factor(F.col("mzs"), F.col("ints"), k, F.col("norm_infile"))
    return rounded(df.select("spectrum_id", *[factor(k).alias(k) for k in ("tic", "sum", "mean", "max", "rms", "internal", "none")]))


@query(f"WITH {CUBE} SELECT x, y, round(CASE WHEN sum(intensity) = 0 THEN 1 ELSE sqrt(avg(intensity * intensity)) END, 6) AS value FROM pts GROUP BY x, y")
def norm_image(spark, sf_dir):
    return images.norm_image(cube(spark, sf_dir), "rms").select("x", "y", r("value").alias("value"))


@query("WITH " + CUBE + " SELECT spectrum_id, pos, round(intensity, 6) AS intensity FROM pts WHERE label <> 0 AND mz BETWEEN 405 AND 407.5")
def masked_subrange(spark, sf_dir):
    df = images.apply_mask(cube(spark, sf_dir), mask(spark, sf_dir))
    at = F.filter(F.sequence(F.lit(0), F.size("mzs") - 1), lambda i: F.get("mzs", i).between(405, 407.5))
    cut = df.select("spectrum_id", F.explode(F.arrays_zip(at.alias("pos"), arrays.subrange(F.col("mzs"), F.col("ints"), F.lit(405.0), F.lit(407.5)).alias("v"))).alias("p"))
    return cut.select("spectrum_id", F.col("p.pos").cast("long").alias("pos"), r("p.v").alias("intensity"))


@query(f"WITH {IMAGE} SELECT x, y, round(CASE WHEN label <> 0 THEN value ELSE 0 END, 6) AS value FROM image")
def masked_image(spark, sf_dir):
    return images.apply_mask(image(spark, sf_dir).drop("label"), mask(spark, sf_dir), keep=True).select("x", "y", r("value").alias("value"))


@query("SELECT p_partkey AS interval_id, 10.0::DOUBLE AS da, round(p_retailprice * 10 * 1e-5, 6) AS ppm, round(p_retailprice * 10 * 1e-6, 6) AS real_ppm FROM part")
def tolerance(spark, sf_dir):
    x = F.col("x_mean")
    return targets(spark, sf_dir).select("interval_id", arrays.tolerance(x, 10, False).alias("da"), r(arrays.tolerance(x, 10, True)).alias("ppm"), r(arrays.tolerance(x, 10, True, 1e-6)).alias("real_ppm"))


@query(f"WITH {CUBE} SELECT spectrum_id, pos, round(log2(intensity + 1), 6) AS log2, round(log10(intensity + 1), 6) AS log10, round(sqrt(intensity), 6) AS sqrt, round(intensity, 6) AS none, round(pow(10, -intensity / 1000) * 100, 6) AS transmittance FROM pts")
def transforms(spark, sf_dir):
    kinds = ("log2", "log10", "sqrt", "none")
    df = cube(spark, sf_dir).select("spectrum_id", *[arrays.transform_intensity(F.col("ints"), k).alias(k) for k in kinds], arrays.transmittance(F.transform("ints", lambda a: a / 1000)).alias("transmittance"))
    cols = (*kinds, "transmittance")
    return df.select("spectrum_id", F.posexplode(F.arrays_zip(*cols)).alias("pos", "p")).select("spectrum_id", F.col("pos").cast("long").alias("pos"), *[r(f"p.{c}").alias(c) for c in cols])


def kernel_terms(weights):
    h = len(weights) // 2
    return " + ".join(f"{w!r} * ints[least(greatest(i + {j - h}, 1), len(ints))]" for j, w in enumerate(map(float, weights)))


def kernel_sql(weights, value="intensity"):
    """Convolution with edge values repeated, as SQL over positions 1 to n of a list."""
    terms = kernel_terms(weights)
    return f"SELECT spectrum_id, i - 1 AS pos, round({terms}, 6) + 0.0 AS intensity FROM (SELECT spectrum_id, ints, unnest(range(1, len(ints) + 1)) AS i FROM cube)"


def exploded(df, column):
    return df.select("spectrum_id", F.posexplode(column).alias("pos", "v")).select("spectrum_id", F.col("pos").cast("long").alias("pos"), r("v").alias("intensity"))


@query(f"WITH {CUBE} {kernel_sql(kernels.polynomial_kernel(4, 2))}")
def smooth_savgol(spark, sf_dir):
    return exploded(cube(spark, sf_dir), signal.smooth(F.col("ints"), "savgol", 4))


@query(f"WITH {CUBE} {kernel_sql(kernels.gauss_kernel(4))}")
def smooth_gauss(spark, sf_dir):
    return exploded(cube(spark, sf_dir), signal.smooth(F.col("ints"), "gauss", 4))


@query(f"WITH {CUBE} {kernel_sql(kernels.polynomial_kernel(5, 4, 1))}")
def derivative_first(spark, sf_dir):
    return exploded(cube(spark, sf_dir), signal.derivative(F.col("ints"), 1))


@query(f"WITH {CUBE} {kernel_sql(kernels.polynomial_kernel(5, 4, 2))}")
def derivative_second(spark, sf_dir):
    return exploded(cube(spark, sf_dir), signal.derivative(F.col("ints"), 2))


AROUND = "OVER (PARTITION BY spectrum_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(f"WITH {CUBE} SELECT spectrum_id, pos, round(min(intensity) {AROUND}, 6) AS intensity FROM pts")
def erosion(spark, sf_dir):
    return exploded(cube(spark, sf_dir), signal.erode(F.col("ints"), 3))


@query(f"WITH {CUBE} SELECT spectrum_id, pos, round(max(intensity) {AROUND}, 6) AS intensity FROM pts")
def dilation(spark, sf_dir):
    return exploded(cube(spark, sf_dir), signal.dilate(F.col("ints"), 3))


@query(f"WITH {CUBE}, e AS (SELECT spectrum_id, pos, intensity, min(intensity) {AROUND} AS e FROM pts) SELECT spectrum_id, pos, round(greatest(0, intensity - max(e) {AROUND}), 6) + 0.0 AS intensity FROM e")
def baseline_tophat(spark, sf_dir):
    return exploded(cube(spark, sf_dir), signal.baseline(F.col("ints"), "tophat", 3))


@query(f"""WITH {CUBE}, w AS (SELECT spectrum_id, i - 1 AS pos, ints[i] AS v, list_transform(range(-4, 1), lambda j: ints[greatest(i + j, 1)]) AS w
  FROM (SELECT spectrum_id, ints, unnest(range(1, len(ints) + 1)) AS i FROM cube))
SELECT spectrum_id, pos, round(greatest(0, v - CASE WHEN list_median(w) < 0 THEN list_max(w) ELSE list_median(w) END), 6) + 0.0 AS intensity FROM w""")
def baseline_median(spark, sf_dir):
    return exploded(cube(spark, sf_dir), signal.baseline(F.col("ints"), "median", 2))


WIDE = "OVER (PARTITION BY spectrum_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"


@query(f"""WITH {CUBE}, {TIC}, n AS (SELECT spectrum_id, list(intensity / f ORDER BY pos) AS ints FROM pts JOIN tic USING (spectrum_id) GROUP BY spectrum_id),
v AS (SELECT spectrum_id, i - 1 AS pos, {kernel_terms(kernels.polynomial_kernel(4, 2))} AS v FROM (SELECT *, unnest(range(1, len(ints) + 1)) AS i FROM n)),
e AS (SELECT *, min(v) {WIDE} AS e FROM v), o AS (SELECT *, max(e) {WIDE} AS o FROM e) SELECT spectrum_id, pos, round(sqrt(greatest(0, v - o)), 6) + 0.0 AS intensity FROM o""")
def processed(spark, sf_dir):
    """The whole chain: factor, smoothing, baseline, transform."""
    df = signal.process(cube(spark, sf_dir), "tic", ("savgol", 4), ("tophat", 10), "sqrt")
    return exploded(df, "ints")


@query(f"WITH {CUBE}, n AS (SELECT spectrum_id, sqrt(sum(intensity * intensity)) AS n FROM pts GROUP BY 1) SELECT spectrum_id, pos, round(CASE WHEN n < 1e-12 THEN intensity ELSE intensity / n END, 6) AS intensity FROM pts JOIN n USING (spectrum_id)")
def vector_normalized(spark, sf_dir):
    return exploded(cube(spark, sf_dir), arrays.vector_normalize(F.col("ints")))


@query(f"""WITH {CUBE}, e AS (SELECT spectrum_id, max(intensity) FILTER (WHERE pos = 19) AS a, max(intensity) FILTER (WHERE pos = 31) AS b, max(mz) FILTER (WHERE pos = 19) AS xa, max(mz) FILTER (WHERE pos = 31) AS xb FROM pts GROUP BY 1)
SELECT spectrum_id, pos, round(CASE WHEN mz BETWEEN 410 AND 415 THEN a + (b - a) * (mz - xa) / (xb - xa) ELSE intensity END, 6) AS intensity FROM pts JOIN e USING (spectrum_id)""")
def bridged_bands(spark, sf_dir):
    return exploded(cube(spark, sf_dir), signal.bridge_bands(F.col("mzs"), F.col("ints"), ((410.0, 415.0),)))


def hat_sql(n: int, degree: int) -> str:
    """Row i of the matrix that fits a polynomial at n points, as a list of lists."""
    import numpy as np

    x = np.vander(np.linspace(-1, 1, n), degree + 1)
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in x @ np.linalg.pinv(x)) + "]"


@query(f"""WITH {CUBE}, h AS (SELECT {hat_sql(64, 2)} AS h)
SELECT spectrum_id, i - 1 AS pos, round(ints[i] - list_inner_product(h[i], ints), 6) + 0.0 AS intensity FROM (SELECT spectrum_id, ints, unnest(range(1, 65)) AS i FROM cube), h""")
def scatter_corrected(spark, sf_dir):
    return exploded(cube(spark, sf_dir), signal.scatter_correct(F.col("mzs"), F.col("ints")))


@query(f"""WITH {CUBE}, t AS (SELECT spectrum_id, pos, pow(10, -intensity / 1000) * 100 AS t FROM pts), n AS (SELECT spectrum_id, sqrt(sum(t * t)) AS n FROM t GROUP BY 1)
SELECT spectrum_id, pos, round(t / n, 6) AS intensity FROM t JOIN n USING (spectrum_id)""")
def mir_chain(spark, sf_dir):
    df = cube(spark, sf_dir).withColumn("ints", F.transform("ints", lambda a: a / 1000))
    return exploded(signal.mir_process(df), "ints")


@query(f"WITH {CUBE} SELECT spectrum_id, round(sum(intensity), 6) AS sum, round(avg(intensity), 6) AS mean, round(max(intensity), 6) AS maximum, round(median(intensity), 6) AS median FROM pts WHERE mz BETWEEN 420 AND 424.5 GROUP BY 1")
def pooled(spark, sf_dir):
    w = arrays.subrange(F.col("mzs"), F.col("ints"), F.lit(420.0), F.lit(424.5))
    return rounded(cube(spark, sf_dir).select("spectrum_id", *[arrays.pool(w, k).alias(k) for k in ("sum", "mean", "maximum", "median")]))


@query(f"""WITH {CENTROIDS}, f AS (SELECT spectrum_id, sum(intensity) AS f FROM peaks GROUP BY 1)
SELECT x, y, round(coalesce(sum(intensity / f) FILTER (WHERE mz BETWEEN 290 AND 310), 0), 6) AS value FROM peaks JOIN f USING (spectrum_id) GROUP BY spectrum_id, x, y""")
def ion_image_centroid(spark, sf_dir):
    return images.ion_image(centroid_spectra(spark, sf_dir), 300.0, 10.0, pooling="sum", centroid_norm="sum").select("x", "y", r("value").alias("value"))


@query(f"""WITH {CUBE} SELECT spectrum_id, s_suppkey AS interval_id, round(avg(intensity), 6) AS value FROM pts JOIN supplier ON mz BETWEEN 400 + abs(s_acctbal) % 32 - 0.6 AND 400 + abs(s_acctbal) % 32 + 0.6 GROUP BY ALL""")
def feature_matrix(spark, sf_dir):
    wanted = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("interval_id"), (400 + F.abs("s_acctbal") % 32).alias("x_mean"))
    return images.feature_matrix(cube(spark, sf_dir), wanted, 0.6).select("spectrum_id", "interval_id", r("value").alias("value"))


@query(f"""WITH {CUBE} SELECT spectrum_id, round(avg(intensity) FILTER (WHERE mz BETWEEN 404.4 AND 405.6), 6) AS f5, round(avg(intensity) FILTER (WHERE mz BETWEEN 419.4 AND 420.6), 6) AS f20 FROM pts GROUP BY 1""")
def feature_matrix_wide(spark, sf_dir):
    df = cube(spark, sf_dir)
    wanted = df.sparkSession.range(5, 21, 15).select(F.col("id").alias("interval_id"), (400.0 + F.col("id")).alias("x_mean"))
    return images.wide(images.feature_matrix(df, wanted, 0.6), [5, 20]).select("spectrum_id", r("5").alias("f5"), r("20").alias("f20"))


@query(f"WITH {CUBE} SELECT pos, mz, round(sum(intensity), 4) AS sum, round(avg(intensity), 6) AS mean, round(greatest(max(intensity), 0), 6) AS max, count(*) AS hits FROM pts GROUP BY pos, mz")
def overview_shared_axis(spark, sf_dir):
    df = images.overview_shared_axis(cube(spark, sf_dir))
    return df.select(F.col("pos").cast("long").alias("pos"), "mz", r("sum", 4).alias("sum"), r("mean").alias("mean"), r("max").alias("max"), "hits")


@query(f"WITH {CUBE}, {TIC} SELECT pos, round(sum(intensity / (f + 2.220446049250313e-16)), 6) AS sum, round(max(intensity / (f + 2.220446049250313e-16)), 6) AS max FROM pts JOIN tic USING (spectrum_id) GROUP BY pos")
def overview_centroid_axis(spark, sf_dir):
    return images.overview_centroid_axis(cube(spark, sf_dir)).select(F.col("pos").cast("long").alias("pos"), r("sum").alias("sum"), r("max").alias("max"))


BIN = "CASE WHEN hi > lo THEN least({n} - 1, floor(({v} - lo) / ((hi - lo) / {n}))) ELSE 0 END"


@query(f"""WITH {CENTROIDS}, e AS (SELECT min(mz) AS lo, max(mz) AS hi FROM peaks)
SELECT CAST({BIN.format(n=1500, v="mz")} AS BIGINT) AS bin, round(avg(mz), 6) AS mz, round(sum(intensity), 6) AS sum, round(sum(intensity) / count(*), 6) AS mean, round(max(intensity), 6) AS max, count(*) AS hits FROM peaks, e GROUP BY 1""")
def overview_binned(spark, sf_dir):
    return rounded(images.overview_binned(centroid_spectra(spark, sf_dir), 1500).drop("dataset_id"))


def slices(spark, sf_dir):
    """Overviews of four slices of the line items, binned at whole numbers."""
    df = lineitem_peaks(spark, sf_dir).withColumn("b", F.floor("mz"))
    return df.groupBy("z", "b").agg(F.avg("mz").alias("mz"), F.sum("intensity").alias("sum"), F.avg("intensity").alias("mean"), F.max("intensity").alias("max"))


@query(f"""WITH p AS (SELECT l_suppkey % 4 AS z, l_extendedprice / 10 AS mz, l_quantity AS intensity FROM lineitem),
o AS (SELECT z, floor(mz) AS b, avg(mz) AS mz, sum(intensity) AS sum, avg(intensity) AS mean, max(intensity) AS max FROM p GROUP BY 1, 2), e AS (SELECT min(mz) AS lo, max(mz) AS hi FROM o)
SELECT CAST({BIN.format(n=300, v="mz")} AS BIGINT) AS bin, round(avg(mz), 9) AS mz, round(avg(sum), 9) AS sum, round(avg(mean), 9) AS mean, max(max) AS max, count(*) AS hits FROM o, e GROUP BY 1""")
def overview_stack(spark, sf_dir):
    return rounded(images.overview_stack(slices(spark, sf_dir), 300), 9)


@query(f"""WITH {CUBE}, t AS (SELECT spectrum_id, pos, label, pow(10, -intensity / 1000) * 100 AS t FROM pts), n AS (SELECT spectrum_id, sqrt(sum(t * t)) AS n FROM t GROUP BY 1)
SELECT pos, round(sum(t / n), 6) AS sum, round(avg(t / n), 6) AS mean, round(max(t / n), 6) AS max FROM t JOIN n USING (spectrum_id) WHERE label <> 0 GROUP BY pos""")
def overview_container(spark, sf_dir):
    df = cube(spark, sf_dir).withColumn("ints", F.transform("ints", lambda a: a / 1000))
    df = images.apply_mask(signal.mir_process(df), mask(spark, sf_dir))
    return images.overview_shared_axis(df).select(F.col("pos").cast("long").alias("pos"), r("sum").alias("sum"), r("mean").alias("mean"), r("max").alias("max"))


@query(f"WITH {CUBE} SELECT label, pos, mz, round(sum(intensity), 4) AS sum, round(avg(intensity), 6) AS mean, round(greatest(max(intensity), 0), 6) AS max FROM pts WHERE label <> 0 GROUP BY label, pos, mz")
def region_spectra(spark, sf_dir):
    df = images.region_spectra(cube(spark, sf_dir).drop("label"), mask(spark, sf_dir))
    return df.select("label", F.col("pos").cast("long").alias("pos"), "mz", r("sum", 4).alias("sum"), r("mean").alias("mean"), r("max").alias("max"))


@query("""SELECT l_orderkey AS list_id, round(sum(l_extendedprice), 2) AS x_sum, min(l_extendedprice) AS x_min, max(l_extendedprice) AS x_max, count(*) AS x_count,
  sum(l_quantity) AS y_sum, min(l_quantity) AS y_min, max(l_quantity) AS y_max, count(*) AS y_count FROM lineitem GROUP BY 1""")
def merged_accumulators(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    one = df.select(F.col("l_orderkey").alias("list_id"), *[v for a, c in (("x", "l_extendedprice"), ("y", "l_quantity")) for v in (*[F.col(c).alias(f"{a}_{k}") for k in ("sum", "min", "max")], F.lit(1).cast("long").alias(f"{a}_count"))])
    return images.merge_accumulators(one, ["list_id"]).withColumn("x_sum", r("x_sum", 2))


@query("SELECT spectrum_id, round(1.4826 * list_sort(list_transform(s, lambda v: abs(v - s[len(s) // 2 + 1])))[len(s) // 2 + 1], 6) AS mad FROM (SELECT spectrum_id, list_sort(ints) AS s FROM cube)".replace("SELECT spectrum_id, round", f"WITH {CUBE} SELECT spectrum_id, round", 1))
def noise_mad(spark, sf_dir):
    return cube(spark, sf_dir).select("spectrum_id", r(arrays.mad(F.col("ints"))).alias("mad"))


@query(f"""WITH {CENTROIDS}, e AS (SELECT min(mz) AS lo, max(mz) - min(mz) AS size FROM peaks)
SELECT CAST(floor(mz / (size / 200)) AS BIGINT) AS bin, round(avg(mz), 6) AS x_mean, sum(intensity) AS y_sum, min(intensity) AS y_min, max(intensity) AS y_max, count(*) AS n FROM peaks, e GROUP BY 1""")
def equidistant_bins(spark, sf_dir):
    df = images.points(centroid_spectra(spark, sf_dir))
    return rounded(images.equidistant_bins(df.select("mz", "intensity"), 200))


@query(f"""WITH {CENTROIDS}, e AS (SELECT min(mz) AS lo, max(mz) - min(mz) AS span FROM peaks),
b AS (SELECT avg(mz) AS mz, avg(intensity) AS mean FROM peaks, e GROUP BY least(1499, floor((mz - lo) / (span / 1500)))), s AS (SELECT max(mz) - min(mz) AS span FROM b),
v AS (SELECT CAST(level AS INTEGER) AS level, avg(mz) AS x, max(mean) AS y FROM b, s, range(7) t(level) GROUP BY level, floor(mz / (span / (1500 >> CAST(level AS INTEGER))))),
d AS (SELECT level FROM v GROUP BY level ORDER BY abs(count(*) / (max(x) - min(x)) - 300.0 / 490.0), level LIMIT 1) SELECT level, round(x, 6) AS x_mean, round(y, 6) AS y_max FROM v JOIN d USING (level)""")
def level_of_detail(spark, sf_dir):
    df = images.overview_binned(centroid_spectra(spark, sf_dir), 1500)
    return rounded(images.level_of_detail(df, 1500, 300.0, 490.0))


@query("SELECT l_suppkey AS series, l_orderkey, l_linenumber, round(l_quantity / max(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS intensity FROM lineitem")
def normalized_series(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("intensity"))
    return images.normalize_series(df, ["series"], "intensity").withColumn("intensity", r("intensity"))


@query(f"""WITH {CUBE}, m AS (SELECT pos, mz, avg(intensity) AS v FROM pts WHERE mz >= 408 AND mz < 412 GROUP BY 1, 2),
mm AS (SELECT * FROM m ORDER BY v DESC, pos LIMIT 1),
o AS (SELECT spectrum_id, pos, mz, intensity AS v, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, pos) AS k FROM pts WHERE mz >= 408 AND mz < 412)
SELECT spectrum_id, CAST(CASE WHEN o.v > 0.3 * mm.v THEN o.pos - mm.pos ELSE 0 END AS INTEGER) AS shift, CASE WHEN o.v > 0.3 * mm.v THEN abs(o.mz - mm.mz) ELSE 0 END AS delta_mz FROM o, mm WHERE k = 1""")
def shift_map(spark, sf_dir):
    return shift.shift_map(cube(spark, sf_dir), 410.0, 2.0).select("spectrum_id", "shift", "delta_mz")


SHIFT = "sh AS (SELECT vec_id AS spectrum_id, vec_id % 5 - 2 AS s FROM embeddings)"


@query(f"""WITH {CUBE}, {SHIFT} SELECT spectrum_id, round(avg(intensity), 6) AS value FROM pts JOIN sh USING (spectrum_id) WHERE pos - s BETWEEN 18 AND 22 GROUP BY 1""")
def ion_image_shifted(spark, sf_dir):
    df = cube(spark, sf_dir)
    moves = df.select("dataset_id", "spectrum_id", (F.col("spectrum_id") % 5 - 2).cast("int").alias("shift"))
    return images.ion_image(df, 410.0, 1.0, shift=moves).select("spectrum_id", r("value").alias("value"))


@query(f"""WITH {CUBE}, {SHIFT}, n AS (SELECT count(*) AS n FROM cube)
SELECT CAST(pos - s + 2 AS INTEGER) AS pos, 400 + 0.5 * (pos - s) AS mz, round(sum(intensity), 4) AS sum, round(sum(intensity) / any_value(n), 6) AS mean, round(max(intensity), 6) AS max FROM pts JOIN sh USING (spectrum_id), n GROUP BY pos - s""")
def overview_shifted(spark, sf_dir):
    df = cube(spark, sf_dir)
    moves = df.select("dataset_id", "spectrum_id", (F.col("spectrum_id") % 5 - 2).cast("int").alias("shift"))
    return shift.overview_shifted(df, moves).select("pos", "mz", r("sum", 4).alias("sum"), r("mean").alias("mean"), r("max").alias("max"))
