"""Operators that SQL doesn't cover, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.functions.scratch import Scratch
from specloom.functions.selection import medians
from specloom.operators import geometry, images, joins, multivariate, peaks, spatial
from specloom.operators.graph import components


def test_chunks_of_a_dense_axis_stay_narrow(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.unique(np.concatenate([np.round(rng.uniform(100, 110, 3000), 3), 400 + 0.01 * np.arange(300)]))
    df = spark.createDataFrame([(float(v),) for v in x], "mz double").repartition(5)
    width = 0.0805
    got = {r["mz"]: r["chunk"] for r in peaks.chunk_starts(df, width, Scratch(spark, "test")).collect()}
    assert sorted(got) == x.tolist()

    def cut(a, b):  # at the widest gap, the first of equal ones, until no range is wider
        todo, out = [(a, b)], []
        while todo:
            a, b = todo.pop()
            if x[b - 1] - x[a] <= width:
                out.append((a, b))
            else:
                c = a + int(np.diff(x[a:b]).argmax()) + 1
                todo += [(a, c), (c, b)]
        return out

    assert got == {v: x[a] for a, b in cut(0, len(x)) for v in x[a:b].tolist()}
    assert max(v - c for v, c in got.items()) <= width


def test_group_bins_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(float(m), float(i), int(i % 7)) for i, m in enumerate(np.round(rng.uniform(100, 110, 300), 3))]
    key = lambda df: sorted((round(r["x_mean"], 9), r["n"], tuple(sorted(r["sources"]))) for r in df.collect())
    df = spark.createDataFrame(rows, "mz double, y double, source long")
    one, many = (key(peaks.group_bins(df.repartition(n), 2e-4)) for n in (1, 6))
    assert one == many
    o = np.lexsort(([r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows]))
    x, s = np.array([r[0] for r in rows])[o], np.array([r[2] for r in rows])[o]
    expected = sorted((round(x[a:b].mean(), 9), b - a, tuple(sorted(s[a:b].tolist()))) for a, b in peaks.split(x, s, 2e-4, peaks.strict, False))
    assert one == expected
    assert peaks.group_bins(df.limit(0), 2e-4).collect() == []
    assert peaks.group_bins(df.limit(1), 2e-4).count() == 1


@pytest.mark.parametrize("shape", ["dense", "equal gaps", "one place", "sparse", "alone"])
def test_strict_bins_in_small_tiles(spark, shape):
    """However the peaks lie, tiles give what one split of all of them gives."""
    rng = np.random.default_rng(3)
    x = {"dense": 100 + rng.random(1500) / 50, "equal gaps": 100 + np.arange(1500) / 4096, "one place": np.full(1500, 100.0), "sparse": rng.uniform(100, 400, 1500), "alone": np.full(5, 100.0)}[shape]
    s = rng.integers(0, 12, len(x)) if shape != "alone" else np.arange(5)
    rows = [(float(m), float(i % 5), int(k)) for i, (m, k) in enumerate(zip(x, s))]
    df = spark.createDataFrame(rows, "mz double, y double, source long").repartition(3)
    got = peaks.strict_bins(df, 1e-3, len(x), len(set(s.tolist())), Scratch(spark, "test"), tile=50)
    o = np.lexsort(([r[1] for r in rows], s, x))
    want = [(x[o][a:b].mean(), b - a, s[o][a:b].tolist()) for a, b in naive_split(x[o], s[o], 1e-3)]
    assert sorted((round(r["x_mean"], 9), r["n"], r["sources"]) for r in got.collect()) == sorted((round(m, 9), n, k) for m, n, k in want)


def naive_split(x, s, tol):
    out, todo, first = [], [(0, len(x))], True
    while todo:
        a, b = todo.pop()
        if not first and (b - a < 2 or peaks.strict(x[a:b], s[a:b], tol)):
            out.append((a, b))
            continue
        first = False
        cut = a + 1 + int(np.diff(x[a:b]).argmax())
        todo += [(a, cut), (cut, b)]
    return out


def test_equal_gaps_take_linear_time():
    n = 200_000
    x, s = 100 + np.arange(n) / 2**20, np.arange(n) % 3
    for rule in (peaks.strict, peaks.relaxed):
        assert sum(b - a for a, b in peaks.split(x, s, 1e-4, rule, False)) == n


@pytest.mark.parametrize("tol", [0.002, 0.1])
def test_group_bins_of_two_sources(spark, tol):
    rows = list(zip([100.0, 200.0, 300.0, 400.0, 500.0, 100.2, 200.2, 300.2, 395.0], [1.0, 2.0, 3.0, 4.0, 5.0, 1.0, 2.0, 3.0, 4.0], [0] * 5 + [1] * 4))
    got = peaks.group_bins(spark.createDataFrame(rows, "mz double, y double, source long"), tol).collect()
    want = {0.002: [(100.1, [0, 1]), (200.1, [0, 1]), (300.1, [0, 1]), (395.0, [1]), (400.0, [0]), (500.0, [0])], 0.1: [(100.1, [0, 1]), (200.1, [0, 1]), (300.1, [0, 1]), (397.5, [1, 0]), (500.0, [0])]}
    assert sorted((round(r["x_mean"], 6), r["sources"]) for r in got) == want[tol]


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
def test_step_peaks_of_long_lists(spark, forward, fallback):
    rng = np.random.default_rng(8)
    lists = [(None if k == 3 else int(k), float(v)) for k, v in zip(rng.choice([0, 0, 0, 0, 1, 2, 3], 900), rng.integers(0, 300, 900))] + [(7, None)]
    centres = [(None if k == 3 else int(k), i, float(v)) for i, (k, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2, 3, 4], 400), rng.integers(-20, 320, 400)))] + [(0, 990, None), (7, 991, 5.0)]
    peaks_of = {k: [v for q, v in lists if q == k and v is not None] for k in {k for k, _ in lists} | {4, 7}}

    def step(k, c):
        if c is None:
            return None
        sign = 1 if forward else -1
        far = [v for v in peaks_of[k] if sign * (v - c) > 6]
        near = [v for v in peaks_of[k] if sign * (v - c) > 0] if fallback else []
        return min(far or near, key=lambda v: sign * v, default=None)

    got = joins.step_peaks(spark.createDataFrame(lists, "list_key long, x_mean double").repartition(4), spark.createDataFrame(centres, "list_key long, centre_id long, centre double"), 6.0, forward, fallback)
    assert sorted((r["centre_id"], r["list_key"], r["x_mean"]) for r in got.collect()) == sorted((i, k, step(k, c)) for k, i, c in centres)


@pytest.mark.parametrize("pooling", ["mean", "sum", "maximum", "median"])
def test_feature_matrix_of_short_and_long_lists(spark, pooling, monkeypatch):
    rng = np.random.default_rng(2)
    spectra = [("d", i, i, 0, 0, (m := np.round(rng.uniform(100, 200, n := int(rng.integers(0, 60))), 2).tolist()), rng.random(n).tolist()) for i in range(30)]
    df = spark.createDataFrame(spectra, "dataset_id string, spectrum_id long, x int, y int, z int, mzs array<double>, ints array<double>")
    wanted = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.uniform(90, 210, 40))] + [(99, None)], "interval_id long, x_mean double")
    rows = lambda: sorted((r["spectrum_id"], r["interval_id"], round(r["value"], 9)) for r in images.feature_matrix(df, wanted, 1.5, pooling=pooling).collect())
    short = rows()
    monkeypatch.setattr(images, "LISTED", 3)
    assert short == rows() and len(short) > 100


def test_medians_of_groups_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(None if g == 2 else int(g), None if v == 7 else float(v)) for g, v in zip(rng.choice([0, 0, 0, 0, 0, 1, 2, 3], 3000), rng.integers(0, 40, 3000))] + [(9, None), (8, 1.5), (7, 1.0), (7, 2.0)]
    got = {r["g"]: r["median"] for r in medians(spark.createDataFrame(rows, "g long, v double").repartition(5), ["g"], "v").collect()}
    assert got == {g: float(np.median([v for k, v in rows if k == g and v is not None])) for g in {r[0] for r in rows} - {9}}


def brute(values, rim, f):
    wide = np.pad(values, [(r, r) for r in rim], mode="edge")
    return f(np.lib.stride_tricks.sliding_window_view(wide, [2 * r + 1 for r in rim]))


@pytest.mark.parametrize("axes", ["xy", "xyz", "x"])
def test_neighbourhoods_in_small_tiles(spark, axes):
    values = np.random.default_rng(4).random((3, 7, 11))
    z, y, x = (a.ravel().tolist() for a in np.indices(values.shape))
    df = spark.createDataFrame([("d", 1, *p, float(v)) for p, v in zip(zip(x, y, z), values.ravel())], "dataset_id string, feature_id long, x int, y int, z int, value double").repartition(3)

    def same(out, want):
        got = {(r["z"], r["y"], r["x"]): r["value"] for r in out.collect()}
        assert len(got) == values.size and np.allclose([got[k] for k in np.ndindex(*values.shape)], want.ravel())

    rim = [int(c in axes) for c in "zyx"]
    same(spatial.smooth_median(df, axes=axes, tile=3), brute(values, rim, lambda w: np.median(w, axis=(-3, -2, -1))))
    weights = [0.5, 0.2, 0.05]
    want = values
    for i, c in enumerate("zyx"):
        if c in axes:
            r = [2 * (j == i) for j in range(3)]
            line = np.array([weights[abs(d)] for d in range(-2, 3)]).reshape([5 if j == i else 1 for j in range(3)])
            want = brute(want, r, lambda w, line=line: (w * line).sum(axis=(-3, -2, -1)))
    same(spatial.smooth_gauss(df, axes=axes, weights=weights, tile=4), want)


@pytest.mark.parametrize(("radius", "flat"), [(1, True), (2, True), (2, False)])
def test_masks_in_small_tiles(spark, radius, flat):
    on = np.random.default_rng(7).random((4, 9, 8)) < 0.25
    z, y, x = (a.ravel().tolist() for a in np.indices(on.shape))
    mask = spark.createDataFrame([("d", *p, int(v)) for p, v in zip(zip(x, y, z), on.ravel())], "dataset_id string, x int, y int, z int, label int").repartition(3)
    steps, size = spatial.ball(radius, flat), on.shape
    inside = lambda p: all(0 <= v < n for v, n in zip(p, size))
    near = lambda p: [q for dx, dy, dz in steps if inside(q := (p[0] + dz, p[1] + dy, p[2] + dx))]
    pixels = lambda df: {(r["z"], r["y"], r["x"]) for r in df.collect()}
    assert pixels(spatial.mask_dilate(mask, radius, flat, tile=3)) == {p for p in np.ndindex(*size) if any(on[q] for q in near(p))}
    assert pixels(spatial.mask_erode(mask, radius, flat, tile=3)) == {p for p in np.ndindex(*size) if all(on[q] for q in near(p))}


@pytest.mark.parametrize("full", [False, True])
def test_components_of_many_small_tiles(spark, full):
    on = np.random.default_rng(9).random((2, 14, 13)) < (0.45 if not full else 0.2)
    z, y, x = (a.ravel().tolist() for a in np.indices(on.shape))
    mask = spark.createDataFrame([("d", *p, int(v)) for p, v in zip(zip(x, y, z), on.ravel())], "dataset_id string, x int, y int, z int, label int").repartition(3)
    group, steps = {}, [d for d in np.ndindex(3, 3, 3) if (sum(abs(v - 1) for v in d) == 1 or full) and d != (1, 1, 1)]
    for p in map(tuple, np.argwhere(on)):
        todo = [p] if p not in group else []
        while todo:
            q = todo.pop()
            if q in group or not all(0 <= v < n for v, n in zip(q, on.shape)) or not on[q]:
                continue
            group[q] = p
            todo += [tuple(int(v + d - 1) for v, d in zip(q, s)) for s in steps]
    sizes = {g: list(group.values()).count(g) for g in group.values()}
    label = {g: i + 1 for i, g in enumerate(sorted(sizes, key=lambda g: (-sizes[g], g)))}
    got = {(r["z"], r["y"], r["x"]): (r["label"], r["size"]) for r in spatial.connected_components(mask, full, tile=4).collect()}
    assert got == {tuple(int(v) for v in p): (label[g], sizes[g]) for p, g in group.items()}


def test_annotations_in_order_of_records(spark):
    rng = np.random.default_rng(12)
    lists = [(f"l{i % 2}", i, float(v), rng.choice(["", None, "named"])) for i, v in enumerate(np.round(rng.uniform(100, 100.3, 120), 3))] + [("l0", 500, 100.1, ""), ("l0", 501, 100.1, None), ("l1", 502, 100.2, ""), ("l1", 503, 100.2, ""), ("once", 600, 100.15, "")]
    records = [(i, float(v), f"r{i}") for i, v in enumerate(np.round(rng.uniform(100, 100.3, 90), 3))] + [(900, None, "none")]
    want = []
    for name in ("l0", "l1"):
        free = sorted((round(v, 4), i) for n, i, v, d in lists if n == name and not d)
        for _, mz, text in sorted(r for r in records if r[1] is not None):
            near = min(free, key=lambda f: (abs(f[0] - mz), f), default=None)
            if near and abs(near[0] - mz) < 0.01:
                want.append((name, near[1], text))
                free.remove(near)
    got = joins.annotate_features(spark.createDataFrame(lists, "list_id string, interval_id long, x_mean double, description string"), spark.createDataFrame(records, "record_id long, mz double, name string").repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 60


def test_stack_checks_axes_and_pixel_sizes(spark):
    one = spark.createDataFrame([(0, 0, 0, [1.0, 2.0]), (1, 0, 0, [1.0, 2.0])], "x int, y int, z int, mzs array<double>")
    two = spark.createDataFrame([(0, 0, 0, [1.0, 2.5])], "x int, y int, z int, mzs array<double>")
    assert [r["x"] for r in geometry.stack([one, one], "x", [(0.1, 0.1, 0.0), (0.10005, 0.1, 0.0)]).orderBy("x").collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="axes"):
        geometry.stack([one, two], "x")
    with pytest.raises(ValueError, match="pixel sizes"):
        geometry.stack([one, one], "y", [(0.1, 0.1, 0.0), (0.1, 0.2, 0.0)])


def test_slices_have_one_format(spark):
    part = lambda f: spark.createDataFrame([(0, 0, f)], "x int, y int, format string")
    assert geometry.stack_slices([part("ContinuousProfile")] * 2).count() == 2
    with pytest.raises(ValueError, match="format"):
        geometry.stack_slices([part("ContinuousProfile"), part("ProcessedProfile")])


def test_merged_lists_drop_equal_means(spark):
    lists = [spark.createDataFrame(rows, "interval_id long, x_mean double") for rows in ([(1, 5.0), (2, 3.0)], [(3, 5.0), (4, 4.0)], [])]
    assert [tuple(r) for r in geometry.merge_peak_lists(lists).collect()] == [(2, 3.0), (4, 4.0), (1, 5.0)]


def test_overview_peaks_with_isotopes(spark):
    axis = np.arange(100.0, 120.0, 0.05)
    y = np.zeros(len(axis))
    for centre, height in ((105.0, 100.0), (106.0, 10.0), (112.0, 50.0)):
        y += height * np.exp(-(((axis - centre) / 0.06) ** 2))
    df = spark.createDataFrame([("d", float(m), float(v)) for m, v in zip(axis, y)], "dataset_id string, mz double, mean double")
    every = [round(r["mz"], 2) for r in peaks.pick_peaks_overview(df, 3.0, 3).orderBy("mz").collect()]
    assert every[:3] == [105.0, 106.0, 112.0]
    extra = spark.createDataFrame([("d", float(130 + i), 0.0) for i in range(8)], "dataset_id string, mz double, mean double")
    first = peaks.pick_peaks_overview(df.union(extra), 3.0, 3, isotopes={"sizes": (2,), "min_cor": 0.5, "tol": 1e-3, "distance": 1.0})
    assert [round(r["mz"], 2) for r in first.collect()] == [105.0]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def grid(spark, text, name="g"):
    rows = [(name, x, y, 0, int(c == "#")) for y, line in enumerate(text.split()) for x, c in enumerate(line)]
    return spark.createDataFrame(rows, "dataset_id string, x int, y int, z int, label int")


def drawn(df, width, height):
    on = {(r["x"], r["y"]) for r in df.collect() if "label" not in r.asDict() or r["label"]}
    return " ".join("".join("#" if (x, y) in on else "." for x in range(width)) for y in range(height))


def test_ring_snake_and_diagonal(spark):
    ring = grid(spark, "..... .###. .#.#. .###. .....")
    assert drawn(spatial.fill_holes(ring, 2), 5, 5) == "..... .###. .###. .###. ....."
    snake = grid(spark, "####.. ...#.. ...### .....#")
    assert {(r["label"], r["size"]) for r in spatial.connected_components(snake, False, 2).collect()} == {(1, 9)}
    blobs = grid(spark, "##.. ##.. ..## ..##")
    assert {r["label"] for r in spatial.connected_components(blobs, False, 2).collect()} == {1, 2}
    assert {r["label"] for r in spatial.connected_components(blobs, True, 2).collect()} == {1}
    full, none = grid(spark, "## ##"), grid(spark, ".. ..")
    assert drawn(spatial.mask_erode(full, 1), 2, 2) == "## ##"
    assert spatial.connected_components(none).collect() == []
    assert drawn(spatial.mask_dilate(grid(spark, "..... ..#.. ....."), 1), 5, 3) == ".###. .###. .###."


def test_matching(spark):
    a = spark.createDataFrame([(1, 100.0, 5.0), (2, 200.0, 1.0), (3, 300.0, 2.0)], "id long, mz double, intensity double")
    b = spark.createDataFrame([(1, 100.05, 9.0), (2, 100.02, 5.5), (3, 200.0, 3.0), (4, 200.01, -1.0)], "id long, mz double, intensity double")
    assert {(r["id_a"], r["id_b"]) for r in joins.match_peaks(a, b, 1e-3).collect()} == {(1, 2), (2, 3)}
    lists = spark.createDataFrame([("l", 1, 10.0, ""), ("l", 2, 10.0, ""), ("l", 3, 20.0, "x"), ("m", 4, 10.0, "")], "list_id string, interval_id long, x_mean double, description string")
    records = spark.createDataFrame([(1, 10.001, "p"), (2, 10.002, "q"), (3, 10.003, "r")], "record_id long, mz double, name string")
    assert {(r["list_id"], r["interval_id"], r["name"]) for r in joins.annotate_features(lists, records).collect()} == {("l", 1, "p"), ("l", 2, "q")}
    axis = spark.createDataFrame([(0, 1.0), (1, 2.0)], "pos long, mz double")
    pts = spark.createDataFrame([(7, 1.1, 3.0), (7, 1.2, 4.0), (7, 1.5, 9.0), (7, 3.0, 1.0)], "spectrum_id long, mz double, intensity double")
    assert [(r["axis_pos"], r["intensity"]) for r in joins.nearest_axis(pts, axis, 0.3).collect()] == [(0, 4.0)]


def matrix(spark, n=60, d=5):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(n, d)) * [3, 2, 1, 1, 0.5] + (np.arange(n) % 3)[:, None] * 6
    return rows, spark.createDataFrame([("d", i, i % 8, i // 8, 0, *map(float, r)) for i, r in enumerate(rows)], "dataset_id string, spectrum_id long, x int, y int, z int, " + ", ".join(f"f{i} double" for i in range(d)))


def test_pca_equals_a_full_svd(spark):
    rows, df = matrix(spark)
    scores, loadings = multivariate.pca(df, 9)
    u, s, vt = np.linalg.svd(rows - rows.mean(axis=1, keepdims=True), full_matrices=False)
    got = np.array([[r[f"pc{i + 1}"] for i in range(4)] for r in scores.orderBy("spectrum_id").collect()])
    assert len(scores.columns) == 5 + 4
    assert np.abs(got) == pytest.approx(np.abs(u[:, :4]), abs=1e-6)
    assert np.abs(loadings) == pytest.approx(np.abs(vt.T[:, :4] * s[:4]), abs=1e-6)


def test_kmeans_from_given_rows(spark):
    rows, df = matrix(spark)
    scaled = (rows - rows.min(0)) / (rows.max(0) - rows.min(0))
    centres = scaled[:3].copy()
    for _ in range(100):
        near = ((scaled[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([scaled[near == c].mean(0) for c in range(3)])
        if np.allclose(new, centres):
            break
        centres = new
    got = [r["label"] - 1 for r in multivariate.kmeans(df, 3, start=scaled[:3]).orderBy("spectrum_id").collect()]
    assert got == near.tolist()


def test_stack_checks_slices(spark):
    a = grid(spark, "## ##").select("x", "y")
    with pytest.raises(ValueError, match="differ"):
        geometry.stack_slices([a, a.filter("x = 0")])
    assert geometry.stack_slices([a, a]).agg(F.max("z")).first()[0] == 1


def test_ion_image_edges(spark):
    df = spark.createDataFrame([("d", 0, 0, 0, 0, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], 0.0), ("d", 1, 1, 0, 0, [], [], 1.0)], "dataset_id string, spectrum_id long, x int, y int, z int, mzs array<double>, ints array<double>, norm_infile double")
    value = lambda *a, **k: [r["value"] for r in images.ion_image(df, *a, **k).orderBy("spectrum_id").collect()]
    assert value(2.0, 1.0) == [5.0, 0.0]
    assert value(9.0, 1.0) == [0.0, 0.0]
    assert value(2.0, 1.0, centroid_norm="internal") == [0.0, 0.0]


def test_clustering_and_projection_see_all_samples(spark):
    from specloom.plans import image_queries

    df = image_queries.matrix(spark, "/root/testdata/sf0.001")
    names = multivariate.features(df)
    assert names == [f"f{i}" for i in range(64)]
    rows = df.orderBy("spectrum_id").collect()
    v = np.array([[r[c] for c in names] for r in rows])
    u, _, _ = np.linalg.svd(v - v.mean(axis=1, keepdims=True), full_matrices=False)
    got = {r["spectrum_id"]: r for r in image_queries.pca_scores(spark, "/root/testdata/sf0.001").collect()}
    scores = np.array([[got[r["spectrum_id"]][f"pc{i}"] for i in (1, 2, 3)] for r in rows])
    assert np.allclose(np.abs(scores), np.abs(u[:, :3]), atol=2e-6)
