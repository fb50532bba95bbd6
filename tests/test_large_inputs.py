"""Operators on inputs that are wide, dense or repeated, in little time and memory."""

from threading import Timer

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.functions import kernels
from specloom.functions.scratch import Scratch
from specloom.operators import images, joins, peaks, signal
from specloom.sources import files
from tests.test_operators import naive_split


@pytest.fixture
def in_time(spark):
    """Ends the test's Spark jobs after a minute and a half."""
    timer = Timer(90, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


@pytest.mark.parametrize("norm", ["tic", "sum", "mean", "max", "rms", "internal", "external"])
@pytest.mark.parametrize("smoothing", [("none", 0), ("savgol", 4)])
def test_long_spectra_are_processed_in_linear_time(spark, in_time, norm, smoothing):
    n, m = 12, 400
    a = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.abs(F.sin(i * F.col("id") + i)) + 1)
    df = spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: 400 + 0.5 * i).alias("mzs"), a.alias("ints"), (F.col("id") + 2.0).alias("norm_infile"), F.when(F.col("id") > 2, F.col("id") * 2.0).alias("side"))
    out = signal.process(df, norm, smoothing, transform="sqrt", external=F.col("side"))
    got = {r["id"]: r["ints"] for r in out.select("id", "ints").collect()}
    for i in range(n):
        y = np.abs(np.sin(np.arange(m) * i + np.arange(m))) + 1
        factor = {"tic": np.trapezoid(y, dx=0.5), "sum": y.sum(), "mean": y.mean(), "max": y.max(), "rms": np.sqrt((y * y).mean()), "internal": i + 2.0, "external": i * 2.0 if i > 2 else 1.0}[norm]
        assert np.allclose(got[i], np.sqrt(kernels.smooth(y[None] / factor, *smoothing)[0]), rtol=1e-12)


def test_many_headers_take_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDER_FILES", 50)
    n = 1000
    text = F.concat(F.lit("NRRD0005\n long:="), F.repeat(F.lit("x"), (F.col("id") % 3 * 9000).cast("int")), F.lit(" \r\nfeature_id:="), F.col("id"), F.lit("\r\n\r\nfeature_id:=1\n\n"), F.repeat(F.lit("\u00ff"), 99))
    assert files.write_headers(spark.range(n).select(text.alias("value")), f"{tmp_path}/out") >= n // 50
    folders = sorted((tmp_path / "out").iterdir())
    (tmp_path / "out/_left").mkdir()
    (tmp_path / "out/_left/0.nrrd").write_text("feature_id:=9\n")
    (folders[0] / ".0.nrrd").write_text("feature_id:=9\n")
    for path in (f"{tmp_path}/out", f"{tmp_path}/out/*", f"file://{tmp_path}/o?t/*/*.nrrd"):
        rows = files.nrrd_headers(spark, path)
        assert rows.rdd.getNumPartitions() <= 16
        got = rows.select("file", "id", F.length(F.col("keys")["long"]).alias("n")).collect()
        assert sorted((r["id"], r["n"]) for r in got) == [(i, i % 3 * 9000) for i in range(n)]
        assert len({r["file"] for r in got}) == n and all(r["file"].startswith(f"file://{tmp_path}/out/") for r in got)
    one = next(folders[0].glob("*.nrrd"))
    assert files.nrrd_headers(spark, str(one)).count() == 1
    assert files.nrrd_headers(spark, f"{folders[0]}/{{{one.name},none}}").select("id").count() == 1  # a pattern of Hadoop's
    with pytest.raises(FileNotFoundError):
        files.nrrd_headers(spark, f"{tmp_path}/absent")


@pytest.mark.parametrize("pooling", ["mean", "median"])
def test_feature_matrix_hands_on_bounded_batches(spark, monkeypatch, pooling):
    n, m = 120, 9000
    ids = F.col("id")
    df = spark.range(n).select(F.lit("d").alias("dataset_id"), ids.alias("spectrum_id"), ids.cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.expr("transform(sequence(0, 15), i -> cast(i + id div 100 as double))").alias("mzs"), F.expr("transform(sequence(0, 15), i -> sin(i * id))").alias("ints"))
    wanted = spark.range(m).select(ids.alias("interval_id"), (ids % 19 * 0.5 - 2).alias("x_mean"))
    kept, original = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *rest: kept.append((self, f)) or original(self, f, *rest))
    out = images.feature_matrix(df, wanted, 1.2, pooling=pooling)
    spectra, run = kept[0]
    assert max(b.nbytes for b in run(iter(spectra.toArrow().combine_chunks().to_batches()))) < 2e6
    pool = {"mean": np.mean, "median": np.median}[pooling]
    got = {(r["spectrum_id"], r["centre"]): (r["n"], r["low"], r["high"]) for r in out.groupBy("spectrum_id", (F.col("interval_id") % 19 * 0.5 - 2).alias("centre")).agg(F.count_distinct("interval_id").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    want = {}
    for i in range(n):
        x, y = np.arange(16.0) + i // 100, np.sin(np.arange(16) * i)
        for k in range(19):
            inside = (x >= k * 0.5 - 2 - 1.2) & (x <= k * 0.5 - 2 + 1.2)
            if inside.any():
                want[i, k * 0.5 - 2] = (len(range(k, m, 19)), float(pool(y[inside])))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == got[k][2] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_records_of_many_equal_intervals_take_few_rounds(spark, monkeypatch):
    """Each x mean 40 times, and more records than intervals at each, so that some go on to the next x mean."""
    rng = np.random.default_rng(4)
    lists = [("l", int(i), 100 + 0.008 * (n % 5), "") for n, i in enumerate(rng.permutation(200))]
    records = [(int(i), 100.003 + 0.008 * (n % 5), f"r{i}") for n, i in enumerate(rng.permutation(220))] + [(1000, 500.0, "far")]
    free, want = sorted((round(v, 4), i) for _, i, v, _ in lists), []
    for _, mz, name in sorted(records):
        near = min(free, key=lambda f: (abs(f[0] - mz), f), default=None)
        if near and abs(near[0] - mz) < 0.01:
            want.append(("l", near[1], name))
            free.remove(near)
    kept, original = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *rest: kept.append(name) or original(self, df, name, *rest))
    got = joins.annotate_features(spark.createDataFrame(lists, "list_id string, interval_id long, x_mean double, description string"), spark.createDataFrame(records, "record_id long, mz double, name string").repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 200
    assert len(kept) <= 10


def test_peaks_of_one_window_make_no_pairs(spark, in_time):
    n = 60_000
    peak = lambda k: spark.range(n).select("id", (100 + F.col("id") % 97 * 1e-4).alias("mz"), (F.col("id") * k % 1_000_003 + 0.25).alias("intensity"))
    got = {r["id_a"]: (r["id_b"], r["intensity_b"]) for r in joins.match_peaks(peak(7919), peak(104_729), 1e-3).collect()}
    b = np.arange(n) * 104_729 % 1_000_003 + 0.25
    line = np.lexsort((np.arange(n), b))
    for i in range(0, n, 37):
        q = i * 7919 % 1_000_003 + 0.25
        near = line[max(0, (k := int(np.searchsorted(b[line], q))) - 2) : k + 2]
        j = min(near.tolist(), key=lambda j: (abs(b[j] - q), j))
        assert got[i] == (j, b[j])
    assert len(got) == n


@pytest.mark.parametrize("tol", [0.0, 1e-3, 0.3, 0.7])
def test_matched_peaks_are_those_of_all_pairs(spark, tol):
    """Ties by hand, peaks at the limit, values that are equally far by rounding, and such as are no numbers."""
    rng = np.random.default_rng(9)
    values = np.array([1.0, 2.0, 2.0, 3.0, 5.0, 1e-18, 2e-18, 0.3, 0.1 + 0.2, np.nan, np.inf, 1e300])
    mzs = np.concatenate([np.round(rng.uniform(100, 101, 40), 2), 100 * (1 + tol) ** np.arange(-4, 5), 100 * (1 - tol) ** np.arange(3), [0.0, 0.0, -5.0]])
    side = lambda: [(int(i), float(rng.choice(mzs)), float(rng.choice(values))) for i in rng.permutation(400)]
    a, b = side(), side()
    far = lambda d: (d != d, d)
    want = {}
    for i, mz, v in a:
        near = [(far(abs(v - w)), j, m, w) for j, m, w in b if abs(mz - m) <= m * tol]
        if near:
            want[i] = min((k if not k[0] else (True, 0.0), j, m, w) for k, j, m, w in near)[1:3]
    df = lambda rows: spark.createDataFrame(rows, "id long, mz double, intensity double").repartition(3)
    got = joins.match_peaks(df(a), df(b), tol).collect()
    assert {r["id_a"]: (r["id_b"], r["mz_b"]) for r in got} == want and len(got) == len(want) > 100


@pytest.mark.parametrize("shape", ["sparse", "even", "steps", "dense", "wide bins"])
@pytest.mark.parametrize("sources", [3000, 40])
def test_strict_bins_of_many_sources_have_small_tiles(spark, monkeypatch, shape, sources):
    """A tile doesn't grow with the sources where the width of a bin limits what it needs."""
    rng, n, tol = np.random.default_rng(8), 3000, {"wide bins": 0.04}.get(shape, 1e-4)
    x = {"sparse": np.round(rng.uniform(100, 400, n), 2), "even": 100 + 0.005 * np.arange(n), "steps": 100 + np.cumsum(rng.choice([0, 0.001, 0.009, 0.019, 0.021, 0.03, 0.06], n)), "dense": 100 + rng.random(n) / 4, "wide bins": rng.uniform(100, 400, n)}[shape]
    s = rng.permutation(n) if sources == n else rng.integers(0, sources, n)
    kept, kind = [], type(spark.range(1).groupBy("id"))
    original = kind.applyInPandas
    monkeypatch.setattr(kind, "applyInPandas", lambda self, *rest: kept.append(self._df) or original(self, *rest))
    df = spark.createDataFrame(list(zip(x.tolist(), [float(k % 5) for k in range(n)], s.tolist())), "mz double, y double, source long").repartition(3)
    got = peaks.strict_bins(df, tol, n, len(np.unique(s)), Scratch(spark, "test"), tile=50)
    o = np.lexsort((np.arange(n) % 5, s, x))
    want = [(round(x[o][a:b].mean(), 9), b - a, s[o][a:b].tolist()) for a, b in naive_split(x[o], s[o], tol)]
    assert sorted((round(r["x_mean"], 9), r["n"], r["sources"]) for r in got.collect()) == sorted(want)
    if shape in ("sparse", "even", "steps"):
        assert max(r["count"] for r in kept[0].groupBy("tile").count().collect()) <= 400
