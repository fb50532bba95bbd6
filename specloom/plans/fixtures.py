"""The driver's tables as spectra, peaks and masks, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.operators import images


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous profile spectra: 64 samples at 400, 400.5, ... on a grid 25 wide; z and label beside."""
    ints = F.transform("embedding", lambda v: F.abs(v.cast("double")) * 1000)
    return read(spark, sf_dir, "embeddings").select(
        F.lit("cube").alias("dataset_id"), F.col("vec_id").alias("spectrum_id"), (F.col("vec_id") % 25).cast("int").alias("x"), F.floor(F.col("vec_id") / 25).cast("int").alias("y"), F.lit(0).alias("z"),
        F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: 400 + 0.5 * i).alias("mzs"), ints.alias("ints"), (1 + F.col("vec_id") % 7).cast("double").alias("norm_infile"), "label",
    )


CUBE = """cube AS (SELECT 'cube' AS dataset_id, vec_id AS spectrum_id, CAST(vec_id % 25 AS INTEGER) AS x, CAST(vec_id // 25 AS INTEGER) AS y, 0 AS z,
  list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)) * 1000) AS ints, CAST(1 + vec_id % 7 AS DOUBLE) AS norm_infile, label FROM embeddings),
pts AS (SELECT spectrum_id, x, y, z, label, norm_infile, i - 1 AS pos, 400 + 0.5 * (i - 1) AS mz, v AS intensity
  FROM (SELECT *, unnest(ints) AS v, unnest(range(1, len(ints) + 1)) AS i FROM cube))"""


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).select("dataset_id", "x", "y", "z", "label")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ion image of the cube with its mask: mean over [409, 411]."""
    df = cube(spark, sf_dir)
    return images.ion_image(df, 410.0, 1.0).join(df.select("spectrum_id", "label"), "spectrum_id").select("dataset_id", F.lit(1).cast("long").alias("feature_id"), "spectrum_id", "x", "y", "z", "value", "label")


IMAGE = CUBE + """,
image AS (SELECT spectrum_id, x, y, z, label, avg(intensity) AS value FROM pts WHERE mz BETWEEN 409 AND 411 GROUP BY ALL)"""


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed centroids, one row a peak: mz is 100 + value, intensity 1 + k."""
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("spectrum_id"), (F.col("user_id") % 15).cast("int").alias("x"), F.floor(F.col("user_id") / 15).cast("int").alias("y"), F.lit(0).alias("z"),
        (100 + F.col("value")).alias("mz"), (1 + F.get_json_object("props", "$.k").cast("double")).alias("intensity"), "event_type",
    )


CENTROIDS = """peaks AS (SELECT event_id, user_id AS spectrum_id, CAST(user_id % 15 AS INTEGER) AS x, CAST(user_id // 15 AS INTEGER) AS y, 0 AS z,
  100 + value AS mz, 1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS intensity, event_type FROM events)"""


def centroid_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as spectra, samples by mz, then event."""
    pairs = F.array_sort(F.collect_list(F.struct("mz", "event_id", "intensity")))
    rows = centroids(spark, sf_dir).groupBy("spectrum_id", "x", "y", "z").agg(pairs.alias("p"))
    return rows.select(F.lit("centroids").alias("dataset_id"), "spectrum_id", "x", "y", "z", F.transform("p", lambda p: p["mz"]).alias("mzs"), F.transform("p", lambda p: p["intensity"]).alias("ints"), F.lit(1.0).alias("norm_infile"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from parts: centres are prices, so windows repeat and overlap."""
    return read(spark, sf_dir, "part").select(F.lit("parts").alias("list_id"), F.col("p_partkey").alias("interval_id"), F.col("p_retailprice").alias("x_mean"), F.col("p_size").cast("double").alias("y_max"), F.col("p_name").alias("description"), F.col("p_brand").alias("color"))


def lineitem_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spectrum_id"), "l_linenumber", (F.col("l_extendedprice") / 10).alias("mz"), F.col("l_quantity").alias("intensity"), (F.col("l_suppkey") % 4).cast("int").alias("z"))
