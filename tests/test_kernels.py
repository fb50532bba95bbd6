"""NumPy kernels against plain formulas and literal vectors."""

import numpy as np
import pytest

from specloom.functions import kernels as K
from specloom.operators import peaks as P

SIGNAL = np.array([5, 5, 9, 5, 5, 5, 5, 0, 4, 4, 4, 6, 6, 6.0])
RNG = np.random.default_rng(3)


def test_running_median_vector():
    assert K.running_median(SIGNAL[None], 1)[0].tolist() == [5, 5, 5, 5, 5, 5, 5, 5, 4, 4, 4, 4, 6, 6]


def test_mad_vector():
    assert K.mad(SIGNAL) == pytest.approx(1.4826)


def test_morphology_by_definition():
    for n in (1, 2, 5, 40):
        y, h = RNG.normal(1, 0.33, (3, n)), 2
        low = np.array([[r[max(0, i - h) : i + h + 1].min() for i in range(n)] for r in y])
        high = np.array([[r[max(0, i - h) : i + h + 1].max() for i in range(n)] for r in y])
        assert np.array_equal(K.erode(y, h), low) and np.array_equal(K.dilate(y, h), high)
        assert (K.baseline(y, "tophat", h) >= 0).all()


def test_smoothing_keeps_what_it_should():
    x = np.arange(50.0)
    quadratic = (0.3 * x**2 - x + 2)[None]
    assert K.smooth(quadratic, "savgol", 4)[0, 4:-4] == pytest.approx(quadratic[0, 4:-4])
    assert K.smooth(np.full((1, 20), 3.0), "gauss", 4) == pytest.approx(3.0)
    assert K.smooth(quadratic, "savgol", 0) is quadratic
    assert K.derivative(quadratic, 1)[0, 5:-5] == pytest.approx((0.6 * x - 1)[5:-5])
    assert K.derivative(quadratic, 2)[0, 5:-5] == pytest.approx(0.6)
    assert K.derivative(quadratic[:, :8], 1) is not None and K.derivative(quadratic[:, :8], 1).shape == (1, 8)


def test_bridge_and_scatter():
    axis = np.arange(1000.0, 4000.0, 10)
    line = (2 * axis + 1)[None]
    bumpy = line + 50.0 * ((axis > 1500) & (axis < 1900))
    assert K.bridge_bands(bumpy, axis) == pytest.approx(line)
    assert np.abs(K.scatter_correct(line, axis)).max() < 1e-6
    assert K.scatter_correct(line[:, :2], axis[:2]).tolist() == line[:, :2].tolist()


def test_local_maxima_of_distinct_values():
    for _ in range(200):
        n, h = int(RNG.integers(1, 40)), int(RNG.integers(1, 5))
        y = RNG.permutation(n).astype(float)
        expected = [i for i in range(n) if n >= 2 * h + 1 and y[i] == y[max(0, i - h) : i + h + 1].max() and y[i] > 2]
        assert K.local_maxima(y, h, 2).tolist() == expected


def test_half_width_of_a_triangle():
    x = np.arange(21.0)
    y = np.maximum(0, 10 - np.abs(x - 10))
    assert K.half_width(x, y, 10) == pytest.approx(10)
    y[10:] = 10
    assert K.half_width(x, y, 10) == pytest.approx(10)  # no right side: twice the left
    assert K.half_width(x, np.full(21, 3.0), 5) == 0


@pytest.mark.parametrize(
    ("y", "found"),
    [
        ([0, 2, 2, 0, 0], [2]),  # the newest of equal ones
        ([0, 2, 2, 2, 0], [3]),
        ([5, 5, 5, 5, 5, 5], [5]),
        ([9, 1, 4, 4, 1, 0, 0], [0, 2]),  # the maximum has left the window: the first in it
        ([1, 1], []),
    ],
)
def test_local_maxima_of_equal_values(y, found):
    assert K.local_maxima(np.array(y, float), 1, 0.0).tolist() == found


def sorted_bins(tol):
    mz, src = np.array([100, 200, 300, 400, 500, 100.2, 200.2, 300.2, 395]), np.array([0] * 5 + [1] * 4)
    o = np.argsort(mz, kind="stable")
    return [(round(mz[o][a:b].mean(), 6), src[o][a:b].tolist()) for a, b in P.split(mz[o], src[o], tol, P.strict, False)]


def test_group_bins_vectors():
    assert sorted_bins(0.002) == [(100.1, [0, 1]), (200.1, [0, 1]), (300.1, [0, 1]), (395.0, [1]), (400.0, [0]), (500.0, [0])]
    assert sorted_bins(0.1) == [(100.1, [0, 1]), (200.1, [0, 1]), (300.1, [0, 1]), (397.5, [1, 0]), (500.0, [0])]


def naive_split(x, s, tol):
    out, todo, first = [], [(0, len(x))], True
    while todo:
        a, b = todo.pop()
        if not first and (b - a < 2 or P.strict(x[a:b], s[a:b], tol)):
            out.append((a, b))
            continue
        first = False
        cut = a + 1 + int(np.diff(x[a:b]).argmax())
        todo += [(a, cut), (cut, b)]
    return sorted(out)


def test_split_by_the_gap_tree():
    for _ in range(300):
        n = int(RNG.integers(2, 25))
        x, s = np.sort(RNG.integers(100, 130, n).astype(float)), RNG.integers(0, 6, n)
        assert P.split(x, s, 0.01, P.strict, False) == naive_split(x, s, 0.01)


def test_isotopes():
    x = np.array([100.0, 101.00235, 102.0047, 150.0, 200.0, 201.00235, 202.0047, 300.0, 400.0])
    assert P.clusters(x, 3, 1.00235, 1e-4) == [[0, 1, 2], [4, 5, 6]]
    # the first kept group is never compared
    assert P.disjoint([[0, 1], [1, 2], [2, 3], [4, 5]]) == [[0, 1], [1, 2], [4, 5]]
