"""Peak picking, alignment of peaks over spectra, and isotope patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.functions import kernels
from specloom.functions.scratch import Scratch, block_offsets, ranged

PEAKS = "dataset_id string, spectrum_id long, x int, y int, z int, mz double, intensity double"


def local_maxima(spectra: DataFrame, hws: int, threshold: float = 0.0, fill_zeros: bool = False) -> DataFrame:
    """Samples that are maxima of their window and above the threshold; with fill_zeros the others come as 0."""
    return pick(spectra, hws, lambda y: threshold, fill_zeros)


def pick_peaks(spectra: DataFrame, snr: float = 1.5, hws: int = 5, centroid: bool = False) -> DataFrame:
    """Maxima above snr times the MAD of each processed spectrum; centroids pass through. No shuffle."""
    if centroid:
        pts = spectra.select("dataset_id", "spectrum_id", "x", "y", "z", F.explode(F.arrays_zip("mzs", "ints")).alias("_p"))
        return pts.select("dataset_id", "spectrum_id", "x", "y", "z", F.col("_p.mzs").alias("mz"), F.col("_p.ints").alias("intensity"))
    return pick(spectra, hws, lambda y: snr * kernels.mad(y))


def pick(spectra: DataFrame, hws: int, level: Callable[[np.ndarray], float], fill_zeros: bool = False) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                x, y = np.asarray(row.mzs, float), np.asarray(row.ints, float)
                at = kernels.local_maxima(y, hws, level(y)) if len(y) else np.zeros(0, np.int64)
                values = y[at]
                if fill_zeros and len(y) >= 2 * hws + 1:
                    full = np.zeros(len(y))
                    full[at] = values
                    at, values = np.arange(len(y)), full
                out.append(pd.DataFrame({"dataset_id": row.dataset_id, "spectrum_id": row.spectrum_id, "x": row.x, "y": row.y, "z": row.z, "mz": x[at], "intensity": values}))
            if out:
                yield pd.concat(out)

    return spectra.select("dataset_id", "spectrum_id", "x", "y", "z", "mzs", "ints").mapInPandas(run, PEAKS)


def strict(x: np.ndarray, sources: np.ndarray, tol: float) -> bool:
    """A group that may stand: all sources differ and every member is within the relative tolerance of the mean."""
    return len(np.unique(sources)) == len(sources) and relaxed(x, sources, tol)


def relaxed(x: np.ndarray, sources: np.ndarray, tol: float) -> bool:
    mean = x.mean()
    return not (np.abs(x - mean) / mean > tol).any()


def farthest(x: np.ndarray, limit: Callable[[float], float], inside: Callable[[float, float], bool]) -> Callable[[int, int], bool]:
    """Test of ranges of sorted peaks by the distance of their ends from the mean, which running sums give; where that
    is so near the limit that rounding may count, the mean is taken of the range itself."""
    sums = np.concatenate(([0.0], np.cumsum(x)))

    def test(a: int, b: int) -> bool:
        mean = (sums[b] - sums[a]) / (b - a)
        far = max(mean - x[a], x[b - 1] - mean)
        if abs(far - limit(mean)) <= 1e-9 * (sums[-1] + 1) / (b - a):
            mean = x[a:b].mean()
            far = max(mean - x[a], x[b - 1] - mean)
        return bool(inside(far, mean))

    return test


def distinct_from(sources: np.ndarray) -> np.ndarray:
    """For each peak the first from which on to it all sources differ."""
    seen: dict[int, int] = {}
    out, low = np.empty(len(sources), np.int64), 0
    for i, s in enumerate(sources.tolist()):
        low = max(low, seen.get(s, -1) + 1)
        seen[s] = i
        out[i] = low
    return out


def prepare_relaxed(x: np.ndarray, sources: np.ndarray, tol: float) -> Callable[[int, int], bool]:
    return farthest(x, lambda mean: mean * tol, lambda far, mean: far / mean <= tol)


def prepare_strict(x: np.ndarray, sources: np.ndarray, tol: float) -> Callable[[int, int], bool]:
    low, near = distinct_from(sources), prepare_relaxed(x, sources, tol)
    return lambda a, b: low[b - 1] <= a and near(a, b)


strict.prepare, relaxed.prepare = prepare_strict, prepare_relaxed


def split(x: np.ndarray, sources: np.ndarray, tol: float, stands: Callable, whole: bool) -> list[tuple[int, int]]:
    """Ranges of the sorted peaks that stand: a range that doesn't is cut at its widest gap, the first of equal ones.

    All cuts come from one tree of gaps, built in a single pass; a rule with `prepare` tests a range in constant time, so many equal gaps
    cost no more than others. whole: the full range may stand itself.
    """
    n = len(x)
    if n < 2:
        return [(0, n)] if n else []
    test = stands.prepare(x, sources, tol) if hasattr(stands, "prepare") else lambda a, b: stands(x[a:b], sources[a:b], tol)
    if whole and test(0, n):
        return [(0, n)]
    tree = gap_tree(np.diff(x))
    out, todo = [], [(0, n, tree[0])]
    first = True
    while todo:
        a, b, gap = todo.pop()
        if not first and (b - a < 2 or test(a, b)):
            out.append((a, b))
            continue
        first = False
        cut = gap + 1
        todo += [(a, cut, tree[1][gap]), (cut, b, tree[2][gap])]
    return sorted(out)


def gap_tree(gaps: np.ndarray) -> tuple[int, list[int], list[int]]:
    """For each gap, the widest to its left and to its right within the range that it cuts (a Cartesian tree, in one pass)."""
    left, right, stack = [-1] * len(gaps), [-1] * len(gaps), []
    for i, g in enumerate(gaps.tolist()):
        last = -1
        while stack and gaps[stack[-1]] < g:
            last = stack.pop()
        left[i] = last
        if stack:
            right[stack[-1]] = i
        stack.append(i)
    return stack[0], left, right


def reach(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last value of the range that each gap is the widest of, the first of equal ones."""
    n = len(gaps)
    first, last, stack = [0] * n, [n] * n, []
    for i, g in enumerate(gaps.tolist()):
        while stack and gaps[stack[-1]] < g:
            last[stack.pop()] = i
        first[i] = stack[-1] + 1 if stack else 0
        stack.append(i)
    return np.array(first, np.int64), np.array(last, np.int64)


def sure_cuts(x: np.ndarray, width: float) -> np.ndarray:
    """For each gap of the sorted values, whether the range that it is the widest gap of, the first of equal ones, is wider than `width`."""
    first, last = reach(np.diff(x))
    return x[last] - x[first] > width


def chunk_starts(peaks: DataFrame, width: float, scratch: Scratch) -> DataFrame:
    """Each mz of the peaks once, with the first mz of its chunk.

    The cuts are those at the widest gap of any range over `width`. Whether a gap is one shows within
    `width` of it, so tiles of the axis find them, each with twice that of its neighbours' values.
    """
    values = peaks.select("mz").distinct()
    if not width > 0:
        return values.withColumn("chunk", F.col("mz"))
    span = 16 * width
    reach = [F.floor((F.col("mz") + d * width) / span) for d in (-2.01, 0, 2.01)]
    tiles = values.withColumn("own", reach[1]).withColumn("tile", F.explode(F.array_distinct(F.array(*reach))))

    def cuts(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("mz")
        x = frame["mz"].to_numpy()
        # what lies further to the left is over `width` away
        new = np.concatenate(([True], sure_cuts(x, width)))
        own = (frame["own"] == frame["tile"]).to_numpy()
        return pd.DataFrame({"mz": x[own], "new": new[own]})

    marked = ranged(scratch, tiles.groupBy("tile").applyInPandas(cuts, "mz double, new boolean"), "starts", "mz")
    start = F.max(F.when(F.col("new"), F.col("mz")))
    before = start.over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    ends = marked.groupBy("_pid").agg(start.alias("mz"), F.lit(True).alias("new")).select("_pid", before.alias("_before"))  # one row a partition
    run = start.over(Window.partitionBy("_pid").orderBy("mz").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_run", run).join(F.broadcast(ends), "_pid").select("mz", F.coalesce("_run", "_before").alias("chunk"))


#: Peaks of a tile at least; how many times as many as the sources it has at least where only they limit what it sees of its neighbours; the
#: largest relative width of a bin for which the width limits that too; other tiles that a tile reaches on the average at most.
TILE, HALO, NARROW, REACH = 1 << 16, 8, 0.1, 4


def bin_row(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple:
    return (x.mean(), x.sum(), x.min(), x.max(), len(x), y.sum(), y.min(), max(0.0, y.max()), s.tolist())


def neighbours(low: np.ndarray, high: np.ndarray, tile: int, edge: int, width: float | None) -> tuple[np.ndarray, ...]:
    """For each tile of `tile` peaks from mz low to mz high: the first and the last tile that see peaks of it, and the least and the greatest mz that it sees.

    It sees `edge` peaks on, and, with a relative width, within the mz that bins which begin in it, and the ranges that tell their ends, can
    reach: a bin takes one width and such a range another before it is too wide, where the gap between may be as wide as both; the rest is room.
    """
    t = np.arange(len(low))
    if width is None:
        least, most = np.full(len(low), -np.inf), np.full(len(low), np.inf)
    else:
        wide = width * high / (1 - width) ** 3
        least, most = np.minimum.accumulate((low - 4 * wide)[::-1])[::-1], np.maximum.accumulate(high + 5 * wide)
    first = np.maximum(np.searchsorted(most, low, "left"), -(-((t - 1) * tile + 1 - edge) // tile))
    last = np.minimum(np.searchsorted(least, high, "right") - 1, ((t + 1) * tile - 1 + edge) // tile)
    return np.clip(first, 0, t), np.clip(last, t, len(low) - 1), least, most


def strict_bins(good: DataFrame, tol: float, n: int, many: int, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """Strict bins of `n` peaks of `many` sources by tiles of their order.

    A range with a source twice, as any of more peaks than there are sources, can't stand, nor can its like that holds it; nor one that is
    wider than 2 tol of its last mz. So a gap is cut for certain if the range that it is the widest gap of is such a range, which shows
    within `many` peaks of it and within some widths of it, and what lies between two of these cuts has `many` peaks and one width at most. A
    tile has those of its neighbours' peaks that are near in both ways and splits what begins in it, so neither a dense axis nor many
    sources alone make it large; where a bin may hold more peaks than a tile, tiles grow with that.
    """
    edge, width = 2 * (many + 1), 2 * tol * (1 + 1e-6)
    narrow = width <= NARROW
    tile = max(tile, n // 100_000, 0 if narrow else HALO // 2 * edge)
    blocks = ranged(scratch, good, "order", "mz", "source", "y")
    before = block_offsets(blocks, ("_rows", F.lit(1)))
    at = F.row_number().over(Window.partitionBy("_pid").orderBy("mz", "source", "y"))
    placed = blocks.withColumn("_at", at).join(before, "_pid").select("mz", "y", "source", (F.col("_rows") + F.col("_at") - 1).alias("i"))
    own = lambda tile: F.floor(F.col("i") / tile).cast("long")
    ends = placed.groupBy(own(tile).alias("own")).agg(F.min("mz"), F.max("mz")).orderBy("own").collect()  # a row a tile
    low, high = (np.array([e[k] for e in ends]) for k in (1, 2))
    while (near := neighbours(low, high, tile, edge, width if narrow else None))[1].sum() - near[0].sum() > REACH * len(low):
        low, high, tile = low[::2], np.append(high[1::2], high[-1:] if len(high) % 2 else []), 2 * tile
    first, last, least, most = (v.tolist() for v in near)
    reaches = [(t, [(k, max(0, k * tile - edge), (k + 1) * tile - 1 + edge, least[k], most[k]) for k in range(first[t], last[t] + 1)]) for t in range(len(low))]
    reaches = good.sparkSession.createDataFrame(reaches, "own long, reach array<struct<tile: long, first: long, last: long, low: double, high: double>>")
    sees = lambda r: F.col("i").between(r["first"], r["last"]) & F.col("mz").between(r["low"], r["high"])
    tiles = placed.withColumn("own", own(tile)).join(F.broadcast(reaches), "own")  # one row a tile
    tiles = tiles.select("mz", "y", "source", "i", "own", F.explode(F.transform(F.filter("reach", sees), lambda r: r["tile"])).alias("tile"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        x, y, s, i = (frame[c].to_numpy() for c in ("mz", "y", "source", "i"))
        first, last = reach(np.diff(x))
        low = distinct_from(s)
        # a little wider than any group, so that rounding can't matter
        sure = (low[last] > first) | (x[last] - x[first] > 2 * tol * x[last] * (1 + 1e-6))
        starts = np.flatnonzero(np.concatenate(([True], sure)))
        ends = np.append(starts[1:], len(x))
        mine = (frame["own"] == frame["tile"]).to_numpy()[starts]
        rows = []
        for a, b in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True):
            alone = i[a] == 0 and i[b - 1] == n - 1
            rows += [bin_row(x[a + u : a + v], y[a + u : a + v], s[a + u : a + v]) for u, v in split(x[a:b], s[a:b], tol, strict, not alone)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BINS.split(", ")])

    return tiles.groupBy("tile").applyInPandas(run, BINS)


def group_bins(peaks: DataFrame, tol: float, stands: Callable = strict, source: str = "source", gap: float | None = None) -> DataFrame:
    """Bins of peaks (mz, y, source) over all spectra: accumulators and source list, exact for any partitioning.

    A group that stands is at most 2 tol max(mz) wide, so all wider ranges are cut first, however dense the
    axis: into chunks of at most that width, and each chunk is split by itself. The full range is cut once
    even if it would stand, which matters only if there is one chunk. Peaks need mz above 0. Ties go by
    source and intensity. Strict bins are cut once more (`strict_bins`), so that no stretch of peaks, however dense, is one task's; for other
    rules the peaks of all spectra within that width are one chunk, the unit of memory.
    """
    scratch = Scratch(peaks.sparkSession, "bins")
    good = scratch.keep(peaks.filter("mz > 0").select("mz", "y", F.col(source).cast("long").alias("source")), "peaks")
    top, n, many = good.agg(F.max("mz"), F.count(F.lit(1)), F.count_distinct("source")).first()
    if top is None:
        return peaks.sparkSession.createDataFrame([], BINS)
    if stands is strict and (2 * tol * (1 + 1e-6) <= NARROW or HALO * (many + 1) <= max(TILE, n // HALO)):
        return strict_bins(good, tol, n, many, scratch)
    gap = 2 * tol * top if gap is None else gap
    # a little wider than any group, so that rounding can't matter
    starts = scratch.keep(chunk_starts(good, gap * (1 + 1e-6), scratch), "chunks")
    ends = starts.agg(F.min("chunk"), F.max("chunk")).first()
    alone = ends[0] == ends[1]
    chunks = good.join(starts, "mz").select("chunk", "mz", "y", "source")

    def bins(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> list[tuple]:
        return [bin_row(x[a:b], y[a:b], s[a:b]) for a, b in split(x, s, tol, stands, not alone)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BINS.split(", ")]
        held: list[list[np.ndarray]] = []  # the chunk that the next frame may go on with
        close = lambda: bins(*(np.concatenate(c) for c in zip(*held, strict=True)))
        at = None
        for frame in frames:
            key = frame["chunk"].to_numpy()
            columns = [frame[c].to_numpy() for c in ("mz", "y", "source")]
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            rows = []
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and key[a] != at:
                    rows += close()
                    held.clear()
                at = key[a]
                held.append([c[a:b] for c in columns])
            yield pd.DataFrame(rows, columns=names)
        if held:
            yield pd.DataFrame(close(), columns=names)

    return chunks.repartition("chunk").sortWithinPartitions("chunk", "mz", "source", "y").mapInPandas(run, BINS)


BINS = "x_mean double, x_sum double, x_min double, x_max double, n long, y_sum double, y_min double, y_max double, sources array<long>"


def tolerance_bins(peaks: DataFrame, tol: float, absolute: bool = False) -> DataFrame:
    """Bins whose peaks are all nearer than tol to their mean (Q2: what the name promises, not one bin for all).

    What is as far as tol but for rounding, a billionth, is not nearer, so that decimal values on the limit fall to one side.
    """
    limit = (lambda mean: tol * (1 - 1e-9)) if absolute else (lambda mean: mean * tol * (1 - 1e-9))

    def near(x: np.ndarray, sources: np.ndarray, tol: float) -> bool:
        mean = x.mean()
        return bool((np.abs(x - mean) < limit(mean)).all())

    near.prepare = lambda x, sources, tol: farthest(x, limit, lambda far, mean: far < limit(mean))
    return group_bins(peaks, tol, near, gap=2 * tol if absolute else None)


def align_pixel_peaks(spectra: DataFrame, snr: float, hws: int, tol: float, percent: float) -> DataFrame:
    """Peaks of all pixels in strict bins that more than `percent` of the pixels share."""
    peaks = pick_peaks(spectra, snr, hws).select("mz", F.col("intensity").alias("y"), F.col("spectrum_id").alias("source"))
    n = spectra.count()
    return group_bins(peaks, tol).filter(F.col("n") > percent / 100 * n)


def bin_list(intervals: DataFrame, tol: float) -> DataFrame:
    """Strict bins over one list: mean x, maximal y, each row its own source."""
    return group_bins(intervals.select(F.col("x_mean").alias("mz"), F.col("y_max").alias("y"), F.col("interval_id").alias("source")), tol)


def distinct_sources(bins: DataFrame) -> DataFrame:
    return bins.withColumn("distinct", F.size(F.array_distinct("sources")) == F.size("sources"))


def combine_lists(lists: list[DataFrame], pixels: list[int | None] | None = None) -> DataFrame:
    """Lists appended, their number as source_id, by x mean.

    pixels: how many pixels each list's image has, null where that isn't known; their sum is pixel_count of the combined list.
    """
    out = None
    for i, one in enumerate(lists):
        one = one.withColumn("source_id", F.lit(i))
        out = one if out is None else out.unionByName(one)
    if pixels is not None:
        out = out.withColumn("pixel_count", F.lit(sum(n or 0 for n in pixels)).cast("long"))
    return out.orderBy("x_mean", "source_id", "interval_id")


def argsort(pts: DataFrame, x: str, *payload: str) -> DataFrame:
    return pts.orderBy(x, *payload)


# Isotopes. One list is small (peaks of one overview), so a list is the unit of work.


def nearest_to_the_right(x: np.ndarray, i: int, target: float) -> int:
    """Walk right from i while the distance to the target falls or stays; the nearest seen."""
    best, at = float("inf"), i
    for j in range(i + 1, len(x)):
        d = abs(x[j] - target)
        if d < best:
            best, at = d, j
        elif d > best:
            break
    return at


def clusters(x: np.ndarray, size: int, distance: float, tol: float) -> list[list[int]]:
    out = []
    for i in range(max(0, len(x) - size)):
        found = [i]
        for s in range(1, size):
            target = x[i] + s * distance
            j = nearest_to_the_right(x, i, target)
            if j == i or not abs(x[j] - target) < x[i] * tol:
                break
            found.append(j)
        if len(found) == size:
            out.append(found)
    return out


def disjoint(groups: list[list[int]]) -> list[list[int]]:
    """Groups in order that share no member with those kept, latest first; the very first kept is never compared (Q7)."""
    kept: list[list[int]] = []
    for g in groups:
        clash = False
        for k in reversed(kept[1:]):
            if g[0] > k[-1]:
                break
            clash = clash or not set(g).isdisjoint(k)
        if not clash:
            kept.append(g)
    return kept


def pattern_fit(x: float, heights: np.ndarray) -> float:
    """Pearson correlation of heights with the Poisson weights at mass x."""
    rate = 0.000594 * x + 0.03091
    weights = np.cumprod(np.concatenate(([1.0], rate / np.arange(1, len(heights)))))
    a, b = heights - heights.mean(), weights - weights.mean()
    norm = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / norm) if norm else float("nan")


def per_list(lists: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return lists.groupBy("list_id").applyInPandas(lambda f: run(f.sort_values(["x_mean", "interval_id"]).reset_index(drop=True)), schema)


def isotope_clusters(lists: DataFrame, size: int, distance: float = 1.00235, tol: float = 1e-4) -> DataFrame:
    """(list_id, interval_ids) of every run of `size` peaks about `distance` apart."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["interval_id"].to_numpy()
        found = clusters(frame["x_mean"].to_numpy(), size, distance, tol)
        rows = [(frame["list_id"].iloc[0], i, j, int(ids[m])) for i, g in enumerate(found) for j, m in enumerate(g)]
        return pd.DataFrame(rows, columns=["list_id", "cluster", "place", "interval_id"])

    flat = per_list(lists, run, "list_id string, cluster int, place int, interval_id long")
    members = F.array_sort(F.collect_list(F.struct("place", "interval_id")))
    return flat.groupBy("list_id", "cluster").agg(F.transform(members, lambda m: m["interval_id"]).alias("interval_ids")).drop("cluster")


def monoisotopic(lists: DataFrame, sizes: tuple[int, ...] = (3, 4, 5, 6, 7, 8, 9, 10), min_cor: float = 0.95, tol: float = 1e-4, distance: float = 1.00235) -> DataFrame:
    """First peaks of the isotope patterns whose heights follow the Poisson weights, without overlaps."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame["x_mean"].to_numpy(), frame["y_max"].to_numpy(float)
        found = []
        for size in sorted(sizes, reverse=True):
            found += disjoint([g for g in clusters(x, size, distance, tol) if pattern_fit(x[g[0]], y[g] / y[g].sum()) > min_cor])
        firsts = [g[0] for g in disjoint(sorted(found))]
        return frame.iloc[firsts][["list_id", "interval_id", "x_mean", "y_max"]]

    return per_list(lists, run, "list_id string, interval_id long, x_mean double, y_max double")


def fwhm(overviews: DataFrame, hws: int = 50, snr: float = 3.0) -> DataFrame:
    """Width at half height of every peak of each overview (dataset_id, mz, mean), all peaks (Q16)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("mz")
        x, y = frame["mz"].to_numpy(), frame["y"].to_numpy(float)
        at = kernels.local_maxima(y, hws, snr * kernels.mad(y))
        return pd.DataFrame({"dataset_id": frame["dataset_id"].iloc[0], "mz": x[at], "y": y[at], "fwhm": [kernels.half_width(x, y, int(i)) for i in at]})

    return overviews.select("dataset_id", "mz", F.col("mean").alias("y")).groupBy("dataset_id").applyInPandas(run, "dataset_id string, mz double, y double, fwhm double")


def pick_peaks_overview(overviews: DataFrame, snr: float, hws: int, isotopes: dict | None = None) -> DataFrame:
    """Peaks of each overview spectrum: one row a list, so a list is the unit.

    isotopes: arguments of `monoisotopic`; then only the first peaks of isotope patterns among the peaks stay.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("mz")
        x, y = frame["mz"].to_numpy(), frame["y"].to_numpy(float)
        at = kernels.local_maxima(y, hws, snr * kernels.mad(y))
        return pd.DataFrame({"dataset_id": frame["dataset_id"].iloc[0], "mz": x[at], "y": y[at], "i": at})

    found = overviews.select("dataset_id", "mz", F.col("mean").alias("y")).groupBy("dataset_id").applyInPandas(run, "dataset_id string, mz double, y double, i long")
    if isotopes is None:
        return found.drop("i")
    lists = found.select(F.col("dataset_id").alias("list_id"), F.col("i").alias("interval_id"), F.col("mz").alias("x_mean"), F.col("y").alias("y_max"))
    return monoisotopic(lists, **isotopes).select(F.col("list_id").alias("dataset_id"), F.col("x_mean").alias("mz"), F.col("y_max").alias("y"))
