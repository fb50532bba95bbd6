"""Queries over peaks, intervals, joins and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.functions import arrays
from specloom.functions.scratch import Scratch
from specloom.operators import geometry, images, joins, peaks
from specloom.plans.fixtures import CENTROIDS, CUBE, centroid_spectra, centroids, cube, lineitem_peaks, read, targets
from specloom.plans.registry import query, r, rounded
from specloom.sources import files, imzml

WINDOW = "OVER (PARTITION BY spectrum_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(f"WITH {CUBE}, m AS (SELECT *, max(intensity) {WINDOW} AS top FROM pts) SELECT spectrum_id, mz, round(intensity, 6) AS intensity FROM m WHERE intensity = top AND intensity > 50")
def local_maxima(spark, sf_dir):
    return rounded(peaks.local_maxima(cube(spark, sf_dir), 3, 50.0).select("spectrum_id", "mz", "intensity"))


@query(f"WITH {CUBE}, m AS (SELECT *, max(intensity) {WINDOW} AS top FROM pts) SELECT spectrum_id, mz, round(CASE WHEN intensity = top AND intensity > 50 THEN intensity ELSE 0 END, 6) AS intensity FROM m")
def local_maxima_filled(spark, sf_dir):
    return rounded(peaks.local_maxima(cube(spark, sf_dir), 3, 50.0, fill_zeros=True).select("spectrum_id", "mz", "intensity"))


MAD = "mad AS (SELECT spectrum_id, 1.4826 * list_sort(list_transform(s, lambda v: abs(v - s[33])))[33] AS noise FROM (SELECT spectrum_id, list_sort(ints) AS s FROM cube))"


@query(f"WITH {CUBE}, {MAD}, m AS (SELECT *, max(intensity) {WINDOW} AS top FROM pts) SELECT spectrum_id, mz, round(intensity, 6) AS intensity FROM m JOIN mad USING (spectrum_id) WHERE intensity = top AND intensity > 1.5 * noise")
def pick_peaks_pixelwise(spark, sf_dir):
    return rounded(peaks.pick_peaks(cube(spark, sf_dir), 1.5, 3).select("spectrum_id", "mz", "intensity"))


@query(f"WITH {CENTROIDS} SELECT spectrum_id, round(mz, 6) AS mz, intensity FROM peaks")
def pick_peaks_centroids(spark, sf_dir):
    return rounded(peaks.pick_peaks(centroid_spectra(spark, sf_dir), centroid=True).select("spectrum_id", "mz", "intensity"))


@query(f"""WITH {CUBE}, m AS (SELECT pos, mz, avg(intensity) AS v FROM pts GROUP BY 1, 2), s AS (SELECT list_sort(list(v)) AS s FROM m), n AS (SELECT 1.4826 * list_sort(list_transform(s, lambda v: abs(v - s[33])))[33] AS noise FROM s),
w AS (SELECT *, max(v) OVER (ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM m) SELECT mz, round(v, 6) AS y FROM w, n WHERE v = top AND v > noise""")
def pick_peaks_overview(spark, sf_dir):
    return rounded(peaks.pick_peaks_overview(images.overview_shared_axis(cube(spark, sf_dir)), 1.0, 2).drop("dataset_id"))


def all_peaks(spark, sf_dir):
    return centroids(spark, sf_dir).select("mz", F.col("intensity").alias("y"), F.col("spectrum_id").alias("source"))


def bins_sql(source: str, stands: str, more: str = "") -> str:
    """Bins of the table bp (mz, source, y), by cutting lists at their widest gap until each stands; the first cut is always made."""
    return f"""WITH RECURSIVE {source},
q AS (SELECT list(mz ORDER BY mz, source, y) AS m, list(source ORDER BY mz, source, y) AS s, list(y ORDER BY mz, source, y) AS y FROM bp),
r AS (SELECT m, s, y, len(m) < 2 AS done FROM q
  UNION ALL SELECT m, s, y, len(m) < 2 OR ({stands}) AS done FROM (
    SELECT unnest([m[:c], m[c + 1:]]) AS m, unnest([s[:c], s[c + 1:]]) AS s, unnest([y[:c], y[c + 1:]]) AS y FROM (
      SELECT *, list_position(g, list_max(g)) AS c FROM (SELECT *, list_transform(list_zip(m[2:], m[:-2]), lambda p: p[1] - p[2]) AS g FROM r WHERE NOT done))))
SELECT round(list_avg(m), 6) AS x_mean, round(list_sum(m), 6) AS x_sum, round(m[1], 6) AS x_min, round(m[-1], 6) AS x_max, len(m) AS n,
  round(list_sum(y), 6) AS y_sum, round(list_min(y), 6) AS y_min, round(greatest(0, list_max(y)), 6) AS y_max{more} FROM r WHERE done"""


FAR = "greatest(list_avg(m) - m[1], m[-1] - list_avg(m))"
DISTINCT = "len(list_distinct(s)) = len(s)"
BY_USER = f"{CENTROIDS}, bp AS (SELECT mz, spectrum_id AS source, intensity AS y FROM peaks)"


@query(bins_sql(BY_USER, f"{DISTINCT} AND {FAR} / list_avg(m) <= 1e-4", f', s AS sources, {DISTINCT} AS "distinct"'))
def group_bins_strict(spark, sf_dir):
    """Peaks of all users in strict bins, source lists and all."""
    return rounded(peaks.distinct_sources(peaks.group_bins(all_peaks(spark, sf_dir), 1e-4)))


@query(bins_sql(BY_USER, f"{FAR} / list_avg(m) <= 5e-5"))
def group_bins_relaxed(spark, sf_dir):
    return rounded(peaks.group_bins(all_peaks(spark, sf_dir), 5e-5, peaks.relaxed).drop("sources"))


@query(bins_sql(BY_USER, f"{FAR} < 0.02 * (1 - 1e-9)"))
def tolerance_bins(spark, sf_dir):
    return rounded(peaks.tolerance_bins(all_peaks(spark, sf_dir), 0.02, absolute=True).drop("sources"))


PICKED = f"{CUBE}, {MAD}, top AS (SELECT *, max(intensity) {WINDOW} AS top FROM pts), bp AS (SELECT mz::DOUBLE AS mz, spectrum_id AS source, intensity AS y FROM top JOIN mad USING (spectrum_id) WHERE intensity = top AND intensity > 1.5 * noise)"


@query(bins_sql(PICKED, f"{DISTINCT} AND {FAR} / list_avg(m) <= 2e-4") + " AND len(m) > 0.05 * (SELECT count(*) FROM embeddings)")
def align_pixel_peaks(spark, sf_dir):
    return rounded(peaks.align_pixel_peaks(cube(spark, sf_dir), 1.5, 3, 2e-4, 5.0).drop("sources"))


@query(bins_sql("bp AS (SELECT p_retailprice AS mz, p_partkey AS source, p_size::DOUBLE AS y FROM part)", f"{DISTINCT} AND {FAR} / list_avg(m) <= 5e-4"))
def bin_list(spark, sf_dir):
    return rounded(peaks.bin_list(targets(spark, sf_dir), 5e-4).drop("sources"))


@query("""WITH a AS (SELECT p_partkey AS interval_id, p_retailprice AS x_mean, 0 AS source_id FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_retailprice, 1 FROM part WHERE p_size >= 15)
SELECT interval_id, x_mean, CAST(source_id AS INTEGER) AS source_id FROM a""")
def combined_lists(spark, sf_dir):
    df = targets(spark, sf_dir)
    return peaks.combine_lists([df.filter("y_max < 20"), df.filter("y_max >= 15")]).select("interval_id", "x_mean", "source_id")


@query("""WITH a AS (SELECT p_partkey AS interval_id, p_retailprice AS x_mean, 0 AS source_id FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_retailprice, 1 FROM part WHERE p_size >= 15)
SELECT interval_id, x_mean, CAST(source_id AS INTEGER) AS source_id, (SELECT count(*) FROM embeddings) + (SELECT count(DISTINCT user_id) FROM events) AS pixel_count FROM a""")
def combined_lists_with_pixels(spark, sf_dir):
    df = targets(spark, sf_dir)
    counts = [cube(spark, sf_dir).count(), centroid_spectra(spark, sf_dir).count()]
    return peaks.combine_lists([df.filter("y_max < 20"), df.filter("y_max >= 15")], counts).select("interval_id", "x_mean", "source_id", "pixel_count")


@query("""WITH a AS (SELECT p_partkey AS interval_id, p_retailprice AS x_mean, p_name, 0 AS l FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_retailprice, p_name, 1 FROM part WHERE p_size >= 15)
SELECT x_mean, arg_min(interval_id, (l, interval_id)) AS interval_id, arg_min(p_name, (l, interval_id)) AS description FROM a GROUP BY x_mean""")
def merged_peak_lists(spark, sf_dir):
    df = targets(spark, sf_dir)
    return geometry.merge_peak_lists([df.filter("y_max < 20"), df.filter("y_max >= 15")]).select("x_mean", "interval_id", "description")


@query("SELECT l_orderkey AS spectrum_id, l_linenumber, l_extendedprice / 10 AS mz, l_quantity AS intensity FROM lineitem")
def sorted_points(spark, sf_dir):
    return peaks.argsort(lineitem_peaks(spark, sf_dir).drop("z"), "mz", "spectrum_id", "l_linenumber", "intensity")


def isotope_lists(spark, sf_dir):
    """Peaks of each spectrum of the events as a list."""
    return centroids(spark, sf_dir).select(F.col("spectrum_id").cast("string").alias("list_id"), F.col("event_id").alias("interval_id"), F.col("mz").alias("x_mean"), F.col("intensity").alias("y_max"))


@query(f"""WITH {CENTROIDS}, p AS (SELECT spectrum_id AS l, event_id AS id, mz AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY spectrum_id) AS n FROM peaks WINDOW w AS (PARTITION BY spectrum_id ORDER BY mz, event_id)),
f AS (SELECT a.l, a.i, a.id, s, any_value(a.x) AS x, arg_min(struct_pack(id := b.id, x := b.x), (abs(b.x - (a.x + s * 1.00235)), b.i)) AS b FROM p a JOIN p b ON b.l = a.l AND b.i > a.i, (VALUES (1), (2)) t(s) WHERE a.i <= a.n - 3 GROUP BY a.l, a.i, a.id, s)
SELECT l::VARCHAR AS list_id, list_prepend(id, list(b.id ORDER BY s)) AS interval_ids FROM f WHERE abs(b.x - (x + s * 1.00235)) < x * 1e-3 GROUP BY l, i, id HAVING count(*) = 2""")
def isotope_clusters(spark, sf_dir):
    return peaks.isotope_clusters(isotope_lists(spark, sf_dir), 3, tol=1e-3)


@query()
def monoisotopic(spark, sf_dir):
    return rounded(peaks.monoisotopic(isotope_lists(spark, sf_dir), (2, 3, 4), 0.9, 2e-3))


@query("""WITH w AS (SELECT p_partkey AS interval_id, i, pow(0.000594 * p_retailprice + 0.03091, i) * exp(-(0.000594 * p_retailprice + 0.03091)) / factorial(CAST(i AS INTEGER)) AS w FROM part, range(5) t(i))
SELECT interval_id, CAST(i AS INTEGER) AS isotope, round(w / sum(w) OVER (PARTITION BY interval_id), 6) AS weight FROM w""")
def poisson_pattern(spark, sf_dir):
    return targets(spark, sf_dir).select("interval_id", F.posexplode(arrays.poisson_pattern(F.col("x_mean"), 5)).alias("isotope", "w")).select("interval_id", "isotope", r("w").alias("weight"))


@query(f"WITH {CUBE} SELECT spectrum_id, round(corr(intensity, mz * mz), 5) AS r FROM pts GROUP BY 1")
def pattern_correlation(spark, sf_dir):
    # the axis less its middle, as moments lose digits on large numbers
    square = F.transform("mzs", lambda m: (m * m - 173056.0) / 1000)
    return cube(spark, sf_dir).select("spectrum_id", r(arrays.correlation(F.transform("ints", lambda a: a / 100), square), 5).alias("r"))


@query(f"""WITH {CUBE}, m AS (SELECT pos, mz::DOUBLE AS x, avg(intensity) AS y FROM pts GROUP BY 1, 2), s AS (SELECT list_sort(list(y)) AS s FROM m), n AS (SELECT 1.4826 * list_sort(list_transform(s, lambda v: abs(v - s[33])))[33] AS noise FROM s),
w AS (SELECT *, max(y) OVER (ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS top FROM m), p AS (SELECT pos, x, y FROM w, n WHERE y = top AND y > 0.5 * noise),
c AS (SELECT p.*, (SELECT max(m.pos) FROM m WHERE m.pos < p.pos AND m.y <= p.y / 2) AS a, (SELECT min(m.pos) FROM m WHERE m.pos > p.pos AND m.y <= p.y / 2) AS b FROM p),
h AS (SELECT c.x, c.y, c.x - (la.x + (lb.x - la.x) * (c.y / 2 - la.y) / (lb.y - la.y)) AS l, ra.x + (rb.x - ra.x) * (c.y / 2 - ra.y) / (rb.y - ra.y) - c.x AS r
  FROM c LEFT JOIN m la ON la.pos = a LEFT JOIN m lb ON lb.pos = a + 1 LEFT JOIN m ra ON ra.pos = b LEFT JOIN m rb ON rb.pos = b - 1),
k AS (SELECT x, y, coalesce(l, r) AS l, coalesce(r, l) AS r FROM h)
SELECT 'cube' AS dataset_id, x AS mz, round(y, 6) AS y, round(coalesce(CASE WHEN l > 2 * r THEN 2 * r WHEN r > 2 * l THEN 2 * l ELSE l + r END, 0), 6) AS fwhm FROM k""")
def fwhm(spark, sf_dir):
    return rounded(peaks.fwhm(images.overview_shared_axis(cube(spark, sf_dir)), 4, 0.5))


@query(f"""WITH {CENTROIDS} SELECT event_id, p_partkey AS interval_id, round(mz, 6) AS mz FROM peaks JOIN part ON mz BETWEEN p_retailprice / 4 - 0.3 AND p_retailprice / 4 + 0.3""")
def range_join(spark, sf_dir):
    wanted = targets(spark, sf_dir).select("interval_id", (F.col("x_mean") / 4).alias("x_mean"))
    return images.range_join(centroids(spark, sf_dir), wanted, "x_mean", 0.3).select("event_id", "interval_id", r("mz").alias("mz"))


AXIS = "axis AS (SELECT i AS axis_pos, 100 + 0.75 * i AS axis_mz FROM range((SELECT count(*) FROM part)) t(i))"


@query(f"""WITH {CENTROIDS}, {AXIS}, h AS (SELECT event_id, spectrum_id, mz, intensity, axis_pos, axis_mz, row_number() OVER (PARTITION BY event_id ORDER BY abs(mz - axis_mz), axis_pos) AS k FROM peaks JOIN axis ON abs(mz - axis_mz) <= 0.25),
l AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id, axis_pos ORDER BY mz DESC, intensity DESC) AS l FROM h WHERE k = 1)
SELECT spectrum_id, axis_pos, axis_mz, round(mz, 6) AS mz, intensity FROM l WHERE l = 1""")
def nearest_axis(spark, sf_dir):
    axis = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), (100 + 0.75 * F.col("p_partkey")).alias("mz"))
    return rounded(joins.nearest_axis(centroids(spark, sf_dir).select("event_id", "spectrum_id", "mz", "intensity"), axis, 0.25))


@query(f"""WITH {CENTROIDS}, a AS (SELECT * FROM peaks WHERE event_id % 2 = 0), b AS (SELECT * FROM peaks WHERE event_id % 2 = 1),
h AS (SELECT a.event_id AS id_a, b.event_id AS id_b, a.mz AS mz_a, b.mz AS mz_b, a.intensity AS intensity_a, b.intensity AS intensity_b, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.intensity - b.intensity), b.event_id) AS k FROM a JOIN b ON abs(a.mz - b.mz) <= b.mz * 0.0005)
SELECT id_a, round(mz_a, 6) AS mz_a, intensity_a, id_b, round(mz_b, 6) AS mz_b, intensity_b FROM h WHERE k = 1""")
def matched_peaks(spark, sf_dir):
    df = centroids(spark, sf_dir).select(F.col("event_id").alias("id"), "mz", "intensity")
    return rounded(joins.match_peaks(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), 0.0005))


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS interval_id, round(p_retailprice, 4) AS v FROM part WHERE p_partkey % 3 <> 0 AND (SELECT count(*) > count(DISTINCT p_retailprice) FROM part)),
w AS (SELECT p_partkey AS record_id, p_brand AS name, interval_id, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(v - (p_retailprice + 0.004)), v, interval_id) AS k FROM part JOIN f ON abs(v - (p_retailprice + 0.004)) < 0.01),
a(t, record_id, k) AS (SELECT 0, record_id, 1 FROM w WHERE k = 1
  UNION ALL SELECT t + 1, record_id, k + lost FROM (SELECT *, max(lost) OVER () AS go FROM (SELECT t, record_id, k, (record_id > min(record_id) OVER (PARTITION BY interval_id))::INT AS lost FROM a JOIN w USING (record_id, k))) WHERE go = 1)
SELECT 'parts' AS list_id, interval_id, name FROM a JOIN w USING (record_id, k) WHERE t = (SELECT max(t) FROM a)""")
def annotated_features(spark, sf_dir):
    df = targets(spark, sf_dir)
    free = df.withColumn("description", F.when(F.col("interval_id") % 3 == 0, F.col("description")).otherwise(""))
    records = df.select(F.col("interval_id").alias("record_id"), (F.col("x_mean") + 0.004).alias("mz"), F.col("color").alias("name"))
    return joins.annotate_features(free, records)


@query("""SELECT (SELECT coalesce(min(p_retailprice) FILTER (WHERE p_retailprice > 950.3 + 0.5), min(p_retailprice) FILTER (WHERE p_retailprice > 950.3)) FROM part) AS next,
  (SELECT coalesce(max(p_retailprice) FILTER (WHERE p_retailprice < 950.3 - 0.5), max(p_retailprice) FILTER (WHERE p_retailprice < 950.3)) FROM part) AS previous""")
def neighbour_peaks(spark, sf_dir):
    df = targets(spark, sf_dir)
    return joins.step_peak(df, 950.3, 0.5).select(F.col("x_mean").alias("next")).join(joins.step_peak(df, 950.3, 0.5, False).select(F.col("x_mean").alias("previous")), F.lit(True))  # one row each


@query("""WITH c AS (SELECT o_orderkey AS centre_id, o_custkey % 25 AS k, 850 + o_totalprice / 2000 AS v FROM orders), p AS (SELECT p_size % 25 AS k, p_retailprice AS x FROM part)
SELECT centre_id, k AS list_key, min(x) AS x_mean FROM c LEFT JOIN p USING (k) WHERE x > v + 0.5 OR x IS NULL GROUP BY ALL
UNION ALL SELECT centre_id, k, NULL FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = c.k AND x > v + 0.5)""")
def next_peaks(spark, sf_dir):
    return joins.step_peaks(*lists_and_centres(spark, sf_dir), 0.5, fallback=False)


def lists_and_centres(spark, sf_dir):
    lists = read(spark, sf_dir, "part").select((F.col("p_size") % 25).cast("long").alias("list_key"), F.col("p_retailprice").alias("x_mean"))
    return lists, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("centre_id"), (F.col("o_custkey") % 25).alias("list_key"), (850 + F.col("o_totalprice") / 2000).alias("centre"))


STEPS = """WITH c AS (SELECT o_orderkey AS centre_id, o_custkey % 25 AS k, 850 + o_totalprice / 2000 AS v FROM orders), p AS (SELECT p_size % 25 AS k, p_retailprice AS x FROM part)
SELECT centre_id, k AS list_key, coalesce({far}, {near}) AS x_mean FROM c LEFT JOIN p USING (k) GROUP BY centre_id, k"""


@query(STEPS.format(far="min(x) FILTER (WHERE x > v + 8.5)", near="min(x) FILTER (WHERE x > v)"))
def next_peaks_or_nearer(spark, sf_dir):
    return joins.step_peaks(*lists_and_centres(spark, sf_dir), 8.5)


@query(STEPS.format(far="max(x) FILTER (WHERE x < v - 8.5)", near="max(x) FILTER (WHERE x < v)"))
def previous_peaks_or_nearer(spark, sf_dir):
    return joins.step_peaks(*lists_and_centres(spark, sf_dir), 8.5, forward=False)


RANGES = "rg AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_suppkey)"


@query(f"""WITH {RANGES} SELECT coalesce(max(CASE WHEN 60010.0 BETWEEN low AND high THEN 60010.0::DOUBLE END), min(low) FILTER (WHERE low > 60000)) AS forward,
  coalesce(max(CASE WHEN 59990.0 BETWEEN low AND high THEN 59990.0::DOUBLE END), max(high) FILTER (WHERE high < 60000)) AS backward FROM rg""")
def neighbour_positions(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    return joins.step_position(df, 60000.0, 10.0).withColumnRenamed("position", "forward").join(joins.step_position(df, 60000.0, 10.0, False).withColumnRenamed("position", "backward"), F.lit(True))  # one row each


@query("SELECT vec_id AS spectrum_id, CASE WHEN vec_id % 3 = 0 THEN label * 2.5 ELSE 1 + vec_id % 7 END AS norm_infile FROM embeddings")
def sidecar_norms(spark, sf_dir):
    df = cube(spark, sf_dir)
    side = df.select(*images.PIXEL, F.when(F.col("spectrum_id") % 3 == 0, F.col("label") * 2.5).alias("norm"))
    return files.attach_sidecar(df, side, "norm", "norm_infile").select("spectrum_id", "norm_infile")


@query("SELECT vec_id AS spectrum_id, CASE WHEN vec_id % 3 = 0 THEN label END AS mask, CASE WHEN vec_id % 4 = 0 THEN vec_id % 5 - 2 ELSE 9 END AS shift FROM embeddings")
def sidecar_mask_and_shift(spark, sf_dir):
    """A mask that only some pixels have, and shifts that override those at hand."""
    df = cube(spark, sf_dir).withColumn("shift", F.lit(9).cast("long"))
    of = lambda n, c, into: df.filter(F.col("spectrum_id") % n == 0).select(*images.PIXEL, c.alias(into)).unionByName(corner(df, into))
    out = files.attach_sidecar(df, of(3, F.col("label"), "side"), "side", "mask")
    return files.attach_sidecar(out, of(4, F.col("spectrum_id") % 5 - 2, "side"), "side", "shift").select("spectrum_id", "mask", "shift")


def corner(df, name):
    """A pixel without a value beyond the last, so that the image covers the data."""
    return df.groupBy("dataset_id").agg(*[(F.max(c) + 1).alias(c) for c in "xyz"]).withColumn(name, F.lit(None).cast("int"))


# Files: written to the shared folder from the driver's tables and read back.


@query("SELECT p_partkey::DOUBLE AS \"p_partkey\", p_name, p_retailprice FROM part")
def table_round_trip(spark, sf_dir):
    path = Scratch(spark, "table").base
    read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.csv(path, sep=";", header=True)
    return files.read_table(spark, path)


@query("SELECT p_brand AS list_id, p_retailprice AS x_mean, p_size::DOUBLE AS y_max FROM part")
def centroids_round_trip(spark, sf_dir):
    path = Scratch(spark, "centroids").base
    targets(spark, sf_dir).select(F.col("x_mean").alias("M/Z"), F.col("y_max").alias("Intensity"), F.col("color").alias("Label")).write.csv(path, sep="\t", header=True)
    return files.read_centroids(spark, path)


@query("SELECT p_retailprice - 0.5 AS x_min, p_retailprice + 0.5 AS x_max, (p_retailprice - 0.5 + (p_retailprice + 0.5)) / 2 AS x_mean, p_name AS description, p_brand AS color FROM part")
def sef_round_trip(spark, sf_dir):
    path = Scratch(spark, "sef").base
    df = targets(spark, sf_dir).select("interval_id", (F.col("x_mean") - 0.5).alias("x_min"), (F.col("x_mean") + 0.5).alias("x_max"), F.lit(2).alias("x_count"), "description", "color")
    files.write_sef(df, path)
    return files.read_sef(spark, path).select("x_min", "x_max", "x_mean", "description", "color")


@query("""WITH i AS (SELECT l_suppkey AS list_id, l_partkey AS interval_id, min(l_extendedprice) AS a, max(l_extendedprice) AS b, avg(l_extendedprice) AS m, min(l_quantity) AS "min", max(l_quantity) AS "max", avg(l_quantity) AS mean FROM lineitem GROUP BY 1, 2)
SELECT list_id, interval_id, round(CASE WHEN row_number() OVER w = 1 THEN b + 0.005 WHEN row_number() OVER w = count(*) OVER (PARTITION BY list_id) THEN a - 0.005 ELSE m END, 6) AS center, "max", "min", round(mean, 6) AS mean FROM i WINDOW w AS (PARTITION BY list_id ORDER BY interval_id)""")
def centroid_table(spark, sf_dir):
    stats = [f(c).alias(f"{a}_{n}") for a, c in (("x", "l_extendedprice"), ("y", "l_quantity")) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    df = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("list_id"), F.col("l_partkey").alias("interval_id")).agg(*stats)
    return rounded(files.centroid_table(df))


@query("SELECT o_orderpriority, o_orderstatus, printf('%.6f', o_custkey::DOUBLE) AS o_custkey, printf('%.6f', o_orderkey::DOUBLE) AS o_orderkey, printf('%.6f', o_totalprice) AS o_totalprice FROM orders")
def plain_table(spark, sf_dir):
    return files.plain_table(read(spark, sf_dir, "orders").drop("o_orderdate"))


@query("SELECT p_partkey AS part, round(p_retailprice, 6) AS mz FROM part WHERE p_partkey % 4 <> 0")
def nrrd_headers(spark, sf_dir):
    path = Scratch(spark, "nrrd").base
    k, x = F.col("p_partkey"), F.col("p_retailprice")
    keys = F.when(k % 4 != 0, F.concat(F.lit("feature_mz_low:="), x - 1, F.lit("\nfeature_mz_high:="), x + 1)).otherwise("other:=1")
    # one file a part: each header is a file
    text = F.concat(F.lit("NRRD0005\npart:="), k.cast("string"), F.lit("\n"), keys, F.lit("\n\nraw"))
    files.write_headers(read(spark, sf_dir, "part").select(text.alias("value")), path)
    out = files.nrrd_headers(spark, f"{path}/*")
    return out.select(F.try_element_at("keys", F.lit("part")).cast("long").alias("part"), r("mz").alias("mz"))


@query(f"""WITH {CUBE}, {CENTROIDS}, a AS (SELECT 'continuous' AS mode, spectrum_id, x, y, mz, intensity, norm_infile FROM pts UNION ALL SELECT 'processed', spectrum_id, x, y, mz, intensity, 1.0 FROM peaks)
SELECT mode, x, y, count(*) AS n, round(min(mz), 6) AS low, round(max(mz), 6) AS high, round(sum(intensity), 6) AS total, round(max_by(mz, (intensity, mz)), 6) AS top, norm_infile FROM a GROUP BY mode, spectrum_id, x, y, norm_infile""")
def imzml_round_trip(spark, sf_dir):
    """Profile spectra as continuous files and centroids as processed ones, written by the tasks and read back by ranges."""
    base = Scratch(spark, "imzml").base
    imzml.write_imzml(cube(spark, sf_dir), f"{base}/continuous", processed=False)
    imzml.write_imzml(centroid_spectra(spark, sf_dir), f"{base}/processed", processed=True, kind="centroid")
    spectra, facts = imzml.read_imzml(spark, f"{base}/*/*.imzML")
    pairs = F.transform(F.arrays_zip("ints", "mzs"), lambda p: F.struct(p["ints"].alias("i"), p["mzs"].alias("m")))
    return rounded(spectra.join(facts.select("dataset_id", "mode"), "dataset_id").select(
        "mode", "x", "y", F.size("mzs").cast("long").alias("n"), F.array_min("mzs").alias("low"), F.array_max("mzs").alias("high"),
        arrays.total(F.col("ints")).alias("total"), F.array_max(pairs)["m"].alias("top"), "norm_infile",
    ))


@query("""WITH i AS (SELECT l_suppkey AS list_id, l_partkey AS interval_id, min(l_extendedprice) AS a, max(l_extendedprice) AS b, avg(l_extendedprice) AS m, min(l_quantity) AS "min", max(l_quantity) AS "max", avg(l_quantity) AS mean FROM lineitem GROUP BY 1, 2)
SELECT round(CASE WHEN row_number() OVER w = 1 THEN b + 0.005 WHEN row_number() OVER w = count(*) OVER (PARTITION BY list_id) THEN a - 0.005 ELSE m END, 6) AS center, "max", "min", round(mean, 6) AS mean FROM i WINDOW w AS (PARTITION BY list_id ORDER BY interval_id)""")
def centroid_file_round_trip(spark, sf_dir):
    path = Scratch(spark, "centroid-table").base
    stats = [f(c).alias(f"{a}_{n}") for a, c in (("x", "l_extendedprice"), ("y", "l_quantity")) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    files.write_centroids(read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("list_id"), F.col("l_partkey").alias("interval_id")).agg(*stats), path)
    return rounded(files.read_table(spark, path))


@query("SELECT o_orderpriority, o_orderstatus, round(o_custkey, 6)::DOUBLE AS o_custkey, round(o_orderkey, 6)::DOUBLE AS o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
def plain_file_round_trip(spark, sf_dir):
    path = Scratch(spark, "plain-table").base
    files.write_table(read(spark, sf_dir, "orders").drop("o_orderdate"), path)
    return rounded(files.read_table(spark, path))
