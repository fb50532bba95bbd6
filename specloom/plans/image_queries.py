"""Queries over images: geometry, scaling, neighbours, masks, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.operators import geometry, images, multivariate, spatial
from specloom.plans.fixtures import CUBE, IMAGE, cube, image, mask, read
from specloom.plans.registry import query, r, rounded


@query("""WITH p AS (SELECT l_orderkey AS id, l_partkey % 1000 AS x, l_suppkey % 90 AS y, l_extendedprice AS v FROM lineitem)
SELECT id, v, CAST(x // 128 AS INTEGER) AS tile_x, CAST(y // 32 AS INTEGER) AS tile_y, x % 128 AS in_x, y % 32 AS in_y, 10 + x // 128 * 128 * 0.5::DOUBLE AS origin_x, y // 32 * 32 * 0.25::DOUBLE AS origin_y FROM p""")
def tiles(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 1000).alias("x"), (F.col("l_suppkey") % 90).alias("y"), F.col("l_extendedprice").alias("v"))
    return geometry.tile(df, 128, 32, (0.5, 0.25), (10.0, 0.0)).drop("x", "y")


@query(f"WITH {CUBE} SELECT spectrum_id, 1.0 - y * 0.5::DOUBLE AS wx, 2.0 + x * 0.25::DOUBLE AS wy, 3.0::DOUBLE AS wz FROM cube")
def world_positions(spark, sf_dir):
    out = geometry.index_to_world(cube(spark, sf_dir), (1.0, 2.0, 3.0), (0.25, 0.5, 1.0), ((0, -1, 0), (1, 0, 0), (0, 0, 1)))
    return out.select("spectrum_id", "wx", "wy", "wz")


#: One geometry row a supplier: size and spacing from its orders.
GEO = """geo AS (SELECT 's' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS dataset_id, 0.0::DOUBLE AS ox, 0.0::DOUBLE AS oy, 0.0::DOUBLE AS oz, 0.5::DOUBLE AS sx, 0.25::DOUBLE AS sy, 1.0::DOUBLE AS sz,
  count(*) AS nx, count(DISTINCT l_partkey) AS ny FROM lineitem GROUP BY l_suppkey)"""


def geo(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("nx"), F.count_distinct("l_partkey").alias("ny"))
    one = {"ox": 0.0, "oy": 0.0, "oz": 0.0, "sx": 0.5, "sy": 0.25, "sz": 1.0}
    return df.select(F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0")).alias("dataset_id"), *[F.lit(v).alias(k) for k, v in one.items()], "nx", "ny")


@query(f"WITH {GEO} SELECT dataset_id, 1.5 + 0.5 * (nx - 1) AS ox, -2.0::DOUBLE AS oy, -0.5::DOUBLE AS sx FROM geo")
def moved_and_mirrored(spark, sf_dir):
    return geometry.mirror(geometry.move(geo(spark, sf_dir), 1.5, -2.0), "x").select("dataset_id", "ox", "oy", "sx")


@query(f"""WITH {GEO}, c AS (SELECT *, 0.5 * (nx - 1) / 2 AS cx, 0.25 * (ny - 1) / 2 AS cy FROM geo), m AS (SELECT avg(cx) AS mx, avg(cy) AS my FROM c), a AS (SELECT radians(30) AS a)
SELECT dataset_id, round(cx - cx * cos(a) + cy * sin(a), 6) + 0.0 AS ox, round(cy - cx * sin(a) - cy * cos(a), 6) + 0.0 AS oy,
  round(mx - mx * cos(a) + my * sin(a), 6) + 0.0 AS shared_ox, round(my - mx * sin(a) - my * cos(a), 6) + 0.0 AS shared_oy FROM c, m, a""")
def rotated(spark, sf_dir):
    df = geo(spark, sf_dir).withColumn("angle", F.lit(0.0))
    own = geometry.rotate(df, 30.0).select("dataset_id", r("ox").alias("ox"), r("oy").alias("oy"))
    return own.join(geometry.rotate(df, 30.0, shared=True).select("dataset_id", r("ox").alias("shared_ox"), r("oy").alias("shared_oy")), "dataset_id")


@query(f"""WITH {GEO}, i AS (SELECT *, row_number() OVER (ORDER BY dataset_id) - 1 AS i FROM geo), e AS (SELECT ceil(count(*) / 7) AS per, max(nx) AS w, max(ny) AS h FROM geo)
SELECT dataset_id, CAST(i % CAST(per AS BIGINT) * w AS DOUBLE) * sx AS ox, floor(i / per) * h * sy AS oy FROM i, e""")
def mosaic(spark, sf_dir):
    return geometry.mosaic(geo(spark, sf_dir), 7).select("dataset_id", "ox", "oy")


@query(f"""WITH {GEO}, l AS (SELECT sx * nx / 2 AS lx, sy * ny / 2 AS ly FROM geo ORDER BY sqrt(pow(sx * nx, 2) + pow(sy * ny, 2)) DESC, dataset_id DESC LIMIT 1)
SELECT dataset_id, lx - sx * nx / 2 AS ox, ly - sy * ny / 2 AS oy FROM geo, l""")
def aligned_centres(spark, sf_dir):
    return geometry.align_centres(geo(spark, sf_dir)).select("dataset_id", "ox", "oy")


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey - min(l_suppkey) OVER w AS x, l_partkey - min(l_partkey) OVER w AS y, max(l_suppkey) OVER w - min(l_suppkey) OVER w + 1 AS nx
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""")
def cropped(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset_id"), F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y"), F.lit(0).alias("z"), "l_orderkey", "l_linenumber", "l_shipdate")
    return geometry.crop_to_min_area(df).select("l_orderkey", "l_linenumber", "l_shipdate", "x", "y", "nx")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS wz, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY CAST(floor(l_quantity * 1.5) AS INTEGER)) - 1 AS z FROM lineitem")
def slices_from_world(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset_id"), "l_orderkey", "l_linenumber", F.col("l_quantity"), (F.col("l_quantity") * 1.5).alias("wz"))
    return geometry.z_from_world(df).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("wz"), F.col("z").cast("long").alias("z"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 AND p_partkey % 3 = 0 THEN sqrt(p_size) WHEN p_partkey % 3 = 1 THEN p_size ELSE 50 END / 1000 AS sx, 0.01::DOUBLE AS sz,
  CASE WHEN p_partkey % 4 = 0 THEN 'processed' ELSE 'continuous' END AS format, CASE WHEN p_partkey % 8 = 0 THEN 'profile' WHEN p_partkey % 4 = 0 THEN 'centroid' ELSE 'profile' END AS type FROM part""")
def dataset_facts(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    meta = read(spark, sf_dir, "part").select(
        "p_partkey", F.when((k % 3 == 0) & (s > 25) | (k % 3 == 1), s).alias("size_x"), F.when(k % 3 == 1, s).alias("size_y"), F.lit(None).cast("double").alias("size_z"),
        F.when(k % 4 == 0, "processed").alias("mode"), F.when(k % 8 == 0, "profile").alias("kind"),
    )
    return geometry.spectrum_format(geometry.pixel_size(meta)).select("p_partkey", "sx", "sz", "format", "type")


@query(f"WITH {IMAGE}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM image) SELECT x, y, round((value - lo) / (hi - lo) * 255, 6) AS value FROM image, e")
def rescaled(spark, sf_dir):
    return geometry.rescale(image(spark, sf_dir), ["feature_id"], 0.0, 255.0).select("x", "y", r("value").alias("value"))


@query(f"WITH {CUBE} SELECT x, y, round(intensity, 6) AS value FROM pts WHERE pos = 9")
def one_component(spark, sf_dir):
    return geometry.select_component(channels(spark, sf_dir, 64), 9).select("x", "y", r("value").alias("value"))


def channels(spark, sf_dir, n):
    """The first n samples of the cube as images."""
    pts = images.points(cube(spark, sf_dir)).filter(F.col("pos") < n)
    return pts.select("dataset_id", F.col("pos").cast("long").alias("feature_id"), "x", "y", "z", F.col("intensity").alias("value"), "label")


@query(f"WITH {IMAGE} SELECT CAST(x // 3 AS INTEGER) AS x, CAST(y // 3 AS INTEGER) AS y, round(value, 6) AS value FROM image WHERE x % 3 = 1 AND y % 3 = 1")
def shrunk(spark, sf_dir):
    return geometry.shrink(image(spark, sf_dir), 3).select("x", "y", r("value").alias("value"))


STATS = "s AS (SELECT avg(value) AS m, stddev_pop(value) AS d, median(value) AS med, min(value) AS lo, max(value) AS hi FROM image WHERE label > 0)"


def norm_sql(expr):
    return f"WITH {IMAGE}, {STATS} SELECT x, y, round(CASE WHEN label > 0 THEN {expr} ELSE value END, 6) + 0.0 AS value FROM image, s"


def norm(kind, expr):
    def run(spark, sf_dir):
        return spatial.image_norm(image(spark, sf_dir).drop("spectrum_id"), kind).select("x", "y", r("value").alias("value"))

    run.__name__ = f"image_norm_{kind}"
    query(norm_sql(expr))(run)


norm("zscore", "(value - m) / d")
norm("pareto", "(value - m) / sqrt(d)")
norm("vast", "(value - m) / (d / m)")
norm("minmax", "(value - lo) / (hi - lo)")
norm("range", "(value - m) / (hi - lo)")
norm("robust", "(value - med) / (SELECT 1.4826 * median(abs(value - med)) FROM image, s WHERE label > 0)")


@query(f"WITH {CUBE} SELECT pos AS feature_id, round(avg(intensity), 6) AS mean, round(stddev_pop(intensity), 6) AS std, round(median(intensity), 6) AS median, round(min(intensity), 6) AS min, round(max(intensity), 6) AS max FROM pts WHERE label > 0 GROUP BY pos")
def masked_stats(spark, sf_dir):
    return rounded(images.masked_stats(channels(spark, sf_dir, 64), ["feature_id"]))


@query(f"""WITH {IMAGE}, e AS (SELECT min(value) AS lo, max(value) - min(value) AS span FROM image), c AS (SELECT CAST(floor((value - lo) / span * 39) AS BIGINT) AS bin, count(*) AS n FROM image, e GROUP BY 1)
SELECT b AS bin, round(lo + (b + 0.5) * span / 40, 6) AS centre, coalesce(n, 0) AS count FROM range(40) t(b) LEFT JOIN c ON c.bin = b, e""")
def histogram(spark, sf_dir):
    return rounded(images.histogram(image(spark, sf_dir), 40))


# The grid is cut to full rows, as images are rectangles.
FULL = IMAGE + ", full_ AS (SELECT x, y, label, value FROM image WHERE y < (SELECT max(y) FROM image)), e AS (SELECT max(x) AS nx, max(y) AS ny FROM full_)"


def full_image(spark, sf_dir):
    df = image(spark, sf_dir)
    top = df.agg(F.max("y").alias("_top"))
    return df.join(F.broadcast(top), F.lit(True)).filter("y < _top").drop("_top")


def around(radius, axes):
    return ", ".join(f"({dx}, {dy})" for dx in (range(-radius, radius + 1) if "x" in axes else [0]) for dy in (range(-radius, radius + 1) if "y" in axes else [0]))


CLAMPED = "least(greatest(a.x + dx, 0), nx)", "least(greatest(a.y + dy, 0), ny)"


@query(f"""WITH {FULL}, o(dx, dy) AS (VALUES {around(1, "xy")})
SELECT a.x, a.y, round(median(b.value), 6) AS value FROM full_ a, o, e JOIN full_ b ON b.x = {CLAMPED[0]} AND b.y = {CLAMPED[1]} GROUP BY a.x, a.y""")
def image_median(spark, sf_dir):
    return spatial.smooth_median(full_image(spark, sf_dir)).select("x", "y", r("value").alias("value"))


WEIGHTS = spatial.bessel_weights()
CASES = "[" + ", ".join(map(repr, WEIGHTS)) + "]"
R = len(WEIGHTS) - 1


@query(f"""WITH {FULL}, ox(dx, dy) AS (VALUES {around(R, "x")}), oy(dx, dy) AS (VALUES {around(R, "y")}),
h AS (SELECT a.x, a.y, sum(b.value * {CASES}[abs(dx) + 1]) AS value FROM full_ a, ox, e JOIN full_ b ON b.x = {CLAMPED[0]} AND b.y = a.y GROUP BY a.x, a.y)
SELECT a.x, a.y, round(sum(b.value * {CASES}[abs(dy) + 1]), 6) AS value FROM h a, oy, e JOIN h b ON b.x = a.x AND b.y = {CLAMPED[1]} GROUP BY a.x, a.y""")
def image_gauss(spark, sf_dir):
    return spatial.smooth_gauss(full_image(spark, sf_dir)).select("x", "y", r("value").alias("value"))


#: Three layers: image, window and colour.
LAYERS = [(3, 0.1, 0.9, 1.0, 0.0, 0.0), (9, 0.0, 0.8, 0.0, 1.0, 0.0), (21, 0.2, 1.0, 0.5, 0.5, 1.0)]
LAYER_SQL = "l(feature_id, low, high, r, g, b, place) AS (VALUES " + ", ".join(f"({i}, {', '.join(f'{v}::DOUBLE' for v in rest)}, {k + 1})" for k, (i, *rest) in enumerate(LAYERS)) + ")"
UNIT = f"""{LAYER_SQL}, u AS (SELECT p.*, l.*, least(1, greatest(0, ((intensity - min(intensity) OVER w) / (max(intensity) OVER w - min(intensity) OVER w) - low) / (high - low))) AS v
  FROM pts p JOIN l ON p.pos = l.feature_id WINDOW w AS (PARTITION BY pos))"""


def layers(spark):
    return spark.createDataFrame(LAYERS, "feature_id long, low double, high double, r double, g double, b double")


@query(f"""WITH {CUBE}, {UNIT}, k AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY v DESC, place) AS k FROM u)
SELECT x, y, round(v * r * 255, 6) AS r, round(v * g * 255, 6) AS g, round(v * b * 255, 6) AS b, place AS winner FROM k WHERE k = 1""")
def composite_max(spark, sf_dir):
    return rounded(spatial.composite(channels(spark, sf_dir, 64), layers(spark), "max").drop("dataset_id", "z"))


@query(f"WITH {CUBE}, {UNIT} SELECT x, y, round(avg(v * r) * 255, 6) AS r, round(avg(v * g) * 255, 6) AS g, round(avg(v * b) * 255, 6) AS b FROM u GROUP BY x, y")
def composite_mean(spark, sf_dir):
    return rounded(spatial.composite(channels(spark, sf_dir, 64), layers(spark), "mean").drop("dataset_id", "z"))


MASK = CUBE + ", m AS (SELECT x, y, CASE WHEN label >= 4 THEN 1 ELSE 0 END AS label FROM cube), e AS (SELECT max(x) AS nx, max(y) AS ny FROM m)"


def half_mask(spark, sf_dir):
    return mask(spark, sf_dir).withColumn("label", (F.col("label") >= 4).cast("int"))


BALL = ", ".join(f"({x}, {y})" for x, y, _ in spatial.ball(1, True))
DILATED = "d AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM m, o, e WHERE label <> 0 AND x + dx BETWEEN 0 AND nx AND y + dy BETWEEN 0 AND ny)"


@query(f"WITH {MASK}, o(dx, dy) AS (VALUES {BALL}), {DILATED} SELECT x, y FROM d")
def mask_dilated(spark, sf_dir):
    return spatial.mask_dilate(half_mask(spark, sf_dir), 1).select("x", "y")


@query(f"WITH {MASK}, o(dx, dy) AS (VALUES {BALL}) SELECT x, y FROM m WHERE label <> 0 AND NOT EXISTS (SELECT 1 FROM o JOIN m b ON b.x = m.x + dx AND b.y = m.y + dy WHERE b.label = 0)")
def mask_eroded(spark, sf_dir):
    return spatial.mask_erode(half_mask(spark, sf_dir), 1).select("x", "y")


@query(f"""WITH {MASK}, o(dx, dy) AS (VALUES {BALL}), {DILATED}, g AS (SELECT m.x, m.y, d.x IS NOT NULL AS on_ FROM m LEFT JOIN d USING (x, y))
SELECT x, y FROM g WHERE on_ AND NOT EXISTS (SELECT 1 FROM o JOIN g b ON b.x = g.x + dx AND b.y = g.y + dy WHERE NOT b.on_)""")
def mask_closed(spark, sf_dir):
    return spatial.mask_close(half_mask(spark, sf_dir), 1).select("x", "y")


def reach(edges, near):
    """Smallest pixel that each foreground pixel reaches."""
    return f"""f AS (SELECT x, y, CAST(y AS BIGINT) * 1048576 + x AS p FROM m WHERE label <> 0), o(dx, dy) AS (VALUES {near}),
n AS (SELECT a.p AS a, b.p AS b FROM f a, o JOIN f b ON b.x = a.x + dx AND b.y = a.y + dy),
{edges}(a, b) AS (SELECT p, p FROM f UNION SELECT {edges}.a, n.b FROM {edges} JOIN n ON n.a = {edges}.b),
c AS (SELECT a AS p, min(b) AS root FROM {edges} GROUP BY a),
s AS (SELECT root, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, root) AS label FROM c GROUP BY root)"""


def labelled(near):
    return f"WITH RECURSIVE {MASK}, {reach('rr', near)} SELECT x, y, CAST(label AS INTEGER) AS label, size FROM f JOIN c USING (p) JOIN s USING (root)"


FACE = "(1, 0), (-1, 0), (0, 1), (0, -1)"


@query(labelled(FACE))
def components_face(spark, sf_dir):
    return spatial.connected_components(half_mask(spark, sf_dir), False, 16).select("x", "y", "label", "size")


@query(labelled(FACE + ", (1, 1), (1, -1), (-1, 1), (-1, -1)").replace("label >= 4", "label >= 7"))
def components_full(spark, sf_dir):
    m = mask(spark, sf_dir).withColumn("label", (F.col("label") >= 7).cast("int"))
    return spatial.connected_components(m, True, 16).select("x", "y", "label", "size")


@query(f"""WITH RECURSIVE {MASK.replace("WHEN label >= 4 THEN 1 ELSE 0", "WHEN label >= 4 THEN 0 ELSE 1")}, {reach("rr", FACE)},
out_ AS (SELECT DISTINCT root FROM f JOIN c USING (p), e WHERE x IN (0, nx) OR y IN (0, ny))
SELECT m.x, m.y, CASE WHEN m.label = 0 OR c.root NOT IN (SELECT root FROM out_) THEN 1 ELSE 0 END AS label FROM m LEFT JOIN f USING (x, y) LEFT JOIN c USING (p)""")
def holes_filled(spark, sf_dir):
    return spatial.fill_holes(half_mask(spark, sf_dir), 16).select("x", "y", "label")


SIZES = "sizes AS (SELECT l_orderkey AS label, count(*) AS size FROM lineitem GROUP BY 1)"


def sizes(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("label")).agg(F.count(F.lit(1)).alias("size"))


@query(f"""WITH {SIZES}, e AS (SELECT min(size) AS lo, max(size) - min(size) AS d FROM sizes)
SELECT CAST(i + 1 AS INTEGER) AS "group", lo + d * i // 3 AS low, lo + d * (i + 1) // 3 - CASE WHEN i < 2 THEN 1 ELSE 0 END AS high FROM e, range(3) t(i)""")
def suggested_groups(spark, sf_dir):
    return spatial.suggest_groups(sizes(spark, sf_dir))


@query(f"""WITH {SIZES}, g(g, low, high) AS (VALUES (1, 1, 4), (2, 3, 6), (3, 9, 10))
SELECT label, size, coalesce(max(g), 0) AS "group" FROM sizes LEFT JOIN g ON size BETWEEN low AND high GROUP BY ALL""")
def assigned_groups(spark, sf_dir):
    groups = spark.createDataFrame([(1, 1, 4), (2, 3, 6), (3, 9, 10)], "group int, low long, high long")
    return spatial.assign_groups(sizes(spark, sf_dir), groups)


def exported(spark, sf_dir):
    clusters = mask(spark, sf_dir).filter("label > 0").select(*images.PIXEL, "label", (F.col("label") % 3).alias("group"))
    df = cube(spark, sf_dir)
    some = df.filter("spectrum_id % 11 != 5").select(*images.PIXEL, F.get("ints", F.lit(3)).alias("f3"), F.get("ints", F.lit(8)).alias("f8"))
    return spatial.export_pixelwise(geometry.index_to_world(df.select(images.PIXEL), spacing=(0.5, 0.5, 1.0)), clusters, some)


EXPORT = f"""{CUBE}, x AS (SELECT spectrum_id, x * 0.5::DOUBLE AS wx, y * 0.5::DOUBLE AS wy, label AS cluster, CASE WHEN label > 0 THEN label % 3 ELSE 0 END AS g,
  CASE WHEN spectrum_id % 11 <> 5 THEN ints[4] END AS f3, CASE WHEN spectrum_id % 11 <> 5 THEN ints[9] END AS f8 FROM cube)"""


@query(f"WITH {EXPORT} SELECT wx, wy, 0.0::DOUBLE AS wz, cluster, g AS \"group\", round(coalesce(f3, 'NaN'::DOUBLE), 6) AS f3, round(coalesce(f8, 'NaN'::DOUBLE), 6) AS f8 FROM x")
def export_pixelwise(spark, sf_dir):
    return rounded(exported(spark, sf_dir))


@query(f"WITH {EXPORT} SELECT cluster, round(avg(wx), 6) AS wx, round(avg(wy), 6) AS wy, 0.0::DOUBLE AS wz, count(*) AS size, max(g) AS \"group\", round(avg(f3), 6) AS f3, round(avg(f8), 6) AS f8 FROM x WHERE cluster > 0 GROUP BY 1")
def export_objectwise(spark, sf_dir):
    return rounded(spatial.export_objectwise(exported(spark, sf_dir)))


@query(f"WITH {CUBE} SELECT z, label, round(avg(x * 0.5), 6) AS wx, round(avg(y * 0.5), 6) AS wy, 0.0::DOUBLE AS wz FROM cube WHERE label <> 0 GROUP BY z, label")
def landmark_centroids(spark, sf_dir):
    return rounded(images.landmark_centroids(geometry.index_to_world(mask(spark, sf_dir), spacing=(0.5, 0.5, 1.0))))


@query("""WITH p AS (SELECT o_orderkey AS id, o_totalprice AS x, o_custkey AS y FROM orders), d AS (SELECT a.id % 50 AS k, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS m FROM p a JOIN p b ON b.id = a.id + 50 GROUP BY 1)
SELECT round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std FROM d""")
def landmark_error(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return rounded(geometry.landmark_error(df, 50), 4)


@query(f"""WITH {CUBE}, e AS (SELECT max(x) + 1 AS n FROM cube WHERE label < 5)
SELECT spectrum_id, CASE WHEN label < 5 THEN x ELSE CAST(x + n AS INTEGER) END AS x, y FROM cube, e""")
def stacked(spark, sf_dir):
    df = cube(spark, sf_dir).select("spectrum_id", "x", "y", "label")
    return geometry.stack([df.filter("label < 5"), df.filter("label >= 5")], "x").select("spectrum_id", "x", "y")


@query(f"WITH {CUBE} SELECT spectrum_id, x, y, CAST(spectrum_id % 2 AS INTEGER) AS z FROM cube")
def stacked_slices(spark, sf_dir):
    df = cube(spark, sf_dir).select("spectrum_id", "x", "y")
    # both halves reach the last column and the last row
    return geometry.stack_slices([df.filter("spectrum_id % 2 = 0"), df.filter("spectrum_id % 2 = 1")])


def matrix(spark, sf_dir, n=64):
    df = cube(spark, sf_dir)
    return df.select("dataset_id", "spectrum_id", "x", "y", "z", *[F.get("ints", F.lit(i)).alias(f"f{i}") for i in range(n)])


def columns_sql(expr):
    return f"WITH {CUBE} SELECT spectrum_id, " + ", ".join(f"round({expr.format(c=f'ints[{i + 1}]')}, 6) + 0.0 AS f{i}" for i in range(64)) + " FROM cube"


@query(columns_sql("({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"))
def minmax_columns(spark, sf_dir):
    return rounded(multivariate.minmax_columns(matrix(spark, sf_dir)).drop("dataset_id", "x", "y", "z"))


@query(columns_sql("({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"))
def standardized_columns(spark, sf_dir):
    return rounded(multivariate.standardize_columns(matrix(spark, sf_dir)).drop("dataset_id", "x", "y", "z"))


@query()
def kmeans_euclid(spark, sf_dir):
    return multivariate.kmeans(matrix(spark, sf_dir), 4).select("spectrum_id", "label")


@query()
def kmeans_spatial_cosine(spark, sf_dir):
    return multivariate.kmeans(matrix(spark, sf_dir), 4, "cosine", 0.5).select("spectrum_id", "label")


@query()
def kmeans_correlation(spark, sf_dir):
    return multivariate.kmeans(matrix(spark, sf_dir), 3, "pearson").select("spectrum_id", "label")


def kmeans_sql(k: int, distance: str, spatial: bool = False, rounds: int = 100) -> str:
    """Rounds of nearest centres and means from the k spectra of least id on, until no centre moves."""
    n = 64 + 3 * spatial
    scaled = ", ".join(f"(ints[{i}] - min(ints[{i}]) OVER ()) / (max(ints[{i}]) OVER () - min(ints[{i}]) OVER ())" for i in range(1, 65))
    places = ", x / max(x) OVER ()::DOUBLE, y / max(y) OVER ()::DOUBLE, 0.0" if spatial else ""
    near = f"list_transform(c, lambda q: {distance}) AS d"
    return f"""WITH RECURSIVE {CUBE}, v AS (SELECT spectrum_id, [{scaled}{places}] AS v FROM cube),
r AS (SELECT 0 AS t, (SELECT list(v ORDER BY spectrum_id) FROM v WHERE spectrum_id < {k}) AS c, true AS go
  UNION ALL SELECT t + 1, m, list_max(list_transform(range(1, {k + 1}), lambda j: list_distance(m[j], c[j]))) > 1e-12 FROM (
    SELECT t, c, list_transform(range(1, {k + 1}), lambda j: coalesce(list_filter(g, lambda e: e.j = j)[1].m, c[j])) AS m FROM (
      SELECT t, c, list(struct_pack(j := j, m := m)) AS g FROM (
        SELECT t, c, list_position(d, list_min(d)) AS j, [{", ".join(f"avg(v[{i}])" for i in range(1, n + 1))}] AS m FROM (SELECT t, c, v, {near} FROM r, v WHERE go AND t < {rounds}) GROUP BY t, c, j) GROUP BY t, c)))
SELECT spectrum_id, CAST(list_position(d, list_min(d)) AS INTEGER) AS label FROM (SELECT spectrum_id, {near} FROM v, (SELECT c FROM r ORDER BY t DESC LIMIT 1))"""


COSINE = "1 - list_cosine_similarity(q, v)"
CENTRED = "1 - list_cosine_similarity(list_transform(q, lambda a: a - list_avg(q)), list_transform(v, lambda a: a - list_avg(v)))"


def first_rows(df, k, spatial=False):
    """The k spectra of least id, as `kmeans` sees them."""
    rows = multivariate.minmax_columns(df).join(df.agg(F.max("x").alias("_x"), F.max("y").alias("_y")), F.lit(True)).orderBy("spectrum_id").limit(k).collect()
    return [[r[f"f{i}"] for i in range(64)] + ([r["x"] / r["_x"], r["y"] / r["_y"], 0.0] if spatial else []) for r in rows]


@query(kmeans_sql(4, "list_distance(q, v)"))
def kmeans_euclid_from_rows(spark, sf_dir):
    df = matrix(spark, sf_dir)
    return multivariate.kmeans(df, 4, start=first_rows(df, 4)).select("spectrum_id", "label")


@query(kmeans_sql(4, COSINE, spatial=True))
def kmeans_cosine_from_rows(spark, sf_dir):
    df = matrix(spark, sf_dir)
    return multivariate.kmeans(df, 4, "cosine", 0.5, start=first_rows(df, 4, spatial=True)).select("spectrum_id", "label")


@query(kmeans_sql(3, CENTRED))
def kmeans_pearson_from_rows(spark, sf_dir):
    df = matrix(spark, sf_dir)
    return multivariate.kmeans(df, 3, "pearson", start=first_rows(df, 3)).select("spectrum_id", "label")


@query()
def pca_scores(spark, sf_dir):
    return rounded(multivariate.pca(matrix(spark, sf_dir), 3)[0].drop("dataset_id", "x", "y", "z"))


@query(f"WITH {CUBE} SELECT spectrum_id, " + ", ".join(f"round((ints[{i}] - min(ints[{i}]) OVER ()) / (max(ints[{i}]) OVER () - min(ints[{i}]) OVER ()) * 255, 6) AS {c}" for i, c in ((1, "r"), (2, "g"), (3, "b"))) + " FROM cube")
def embedding_colours(spark, sf_dir):
    return rounded(multivariate.embed_to_rgb(matrix(spark, sf_dir, 8), ("f0", "f1", "f2")).drop("dataset_id", "x", "y", "z"))
