"""NumPy kernels on blocks of spectra: rows are spectra, columns are samples."""

from __future__ import annotations

from math import factorial

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def polynomial_kernel(hws: int, degree: int, derivative: int = 0) -> np.ndarray:
    """Weights that give the derivative at the middle of a least-squares polynomial over 2 hws + 1 points."""
    x = np.arange(-hws, hws + 1, dtype=float)
    return np.linalg.pinv(np.vander(x, degree + 1, increasing=True))[derivative] * factorial(derivative)


def gauss_kernel(hws: int) -> np.ndarray:
    x = np.arange(-hws, hws + 1)
    w = np.exp(-0.5 * (x / (hws / 4)) ** 2)
    return w / w.sum()


def windows(block: np.ndarray, left: int, right: int, mode: str = "edge", fill: float = 0.0) -> np.ndarray:
    """Window of left + 1 + right samples at each sample; beyond the ends the edge value, or `fill`."""
    pad = ((0, 0), (left, right))
    padded = np.pad(block, pad, mode="edge") if mode == "edge" else np.pad(block, pad, constant_values=fill)
    return sliding_window_view(padded, left + right + 1, axis=1)


def convolve(block: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    h = len(kernel) // 2
    return windows(block, h, h) @ kernel if h and block.shape[1] else block


def smooth(block: np.ndarray, kind: str, hws: int) -> np.ndarray:
    """savgol (quadratic) or gauss (sigma hws / 4); hws 0 means none (Q10)."""
    if not hws or kind == "none":
        return block
    return convolve(block, polynomial_kernel(hws, 2) if kind == "savgol" else gauss_kernel(hws))


def erode(block: np.ndarray, hws: int) -> np.ndarray:
    return windows(block, hws, hws, "fill", np.inf).min(axis=2) if block.shape[1] else block


def dilate(block: np.ndarray, hws: int) -> np.ndarray:
    return windows(block, hws, hws, "fill", -np.inf).max(axis=2) if block.shape[1] else block


def running_median(block: np.ndarray, hws: int) -> np.ndarray:
    """Median of the last 2 hws + 1 samples, the first value standing in before the start; the window's maximum where that is negative."""
    if not block.shape[1]:
        return block
    w = windows(block, 2 * hws, 0)
    m = np.median(w, axis=2)
    return np.where(m < 0, w.max(axis=2), m)


def baseline(block: np.ndarray, kind: str, hws: int) -> np.ndarray:
    if kind == "none":
        return block
    under = dilate(erode(block, hws), hws) if kind == "tophat" else running_median(block, hws)
    return np.maximum(0, block - under)


def norm_factors(axes: np.ndarray | None, block: np.ndarray, kind: str) -> np.ndarray:
    """Factor of each spectrum of a block by tic (which needs the axes), sum, mean, max, rms or none."""
    n = block.shape[1]
    if kind == "tic":
        return ((block[:, 1:] + block[:, :-1]) * np.diff(axes, axis=1) / 2).sum(axis=1) if n else np.ones(len(block))
    if kind in ("mean", "max", "rms") and not n:
        return np.full(len(block), np.nan)
    by = {"sum": lambda b: b.sum(axis=1), "mean": lambda b: b.mean(axis=1), "max": lambda b: b.max(axis=1), "rms": lambda b: np.sqrt((b * b).mean(axis=1))}
    return by[kind](block) if kind in by else np.ones(len(block))


def transformed(block: np.ndarray, kind: str) -> np.ndarray:
    """log2 and log10 of a + 1, sqrt of a, or none."""
    return {"log2": lambda a: np.log2(a + 1), "log10": lambda a: np.log10(a + 1), "sqrt": np.sqrt, "none": lambda a: a}[kind](block)


def derivative(block: np.ndarray, order: int = 1, hws: int = 5, degree: int = 4) -> np.ndarray:
    """Savitzky-Golay derivative at unit steps; spectra of fewer than 2 hws + 1 samples stay as they are."""
    return convolve(block, polynomial_kernel(hws, degree, order)) if block.shape[1] > 2 * hws else block


#: Bands of the water and carbon dioxide lines, in 1/cm.
BANDS = ((1500.0, 1900.0), (2280.0, 2400.0), (3540.0, 3900.0))


def bridge_bands(block: np.ndarray, axis: np.ndarray, bands=BANDS) -> np.ndarray:
    """Inside each band, in turn, the straight line between the samples just outside; bands that reach an end stay."""
    out = block.copy()
    order = np.argsort(axis)
    for low, high in bands:
        inside = np.flatnonzero((axis >= low) & (axis <= high))
        before, after = order[axis[order] < low], order[axis[order] > high]
        if len(inside) and len(before) and len(after):
            a, b = before[-1], after[0]
            share = (axis[inside] - axis[a]) / (axis[b] - axis[a])
            out[:, inside] = out[:, [a]] * (1 - share) + out[:, [b]] * share
    return out


def scatter_correct(block: np.ndarray, axis: np.ndarray, degree: int = 2) -> np.ndarray:
    """Less the least-squares polynomial over the axis scaled to [-1, 1]; too few samples stay."""
    n = block.shape[1]
    if n < degree + 1:
        return block
    span = axis.max() - axis.min()
    x = np.vander(2 * (axis - axis.min()) / span - 1 if span else np.zeros(n), degree + 1)
    return block - block @ np.linalg.pinv(x).T @ x.T


def local_maxima(y: np.ndarray, hws: int, threshold: float) -> np.ndarray:
    """Positions that are the maximum of the samples around them and above the threshold.

    Among equal values the newest to enter the window wins; once the maximum has left the window, the
    first of the values in it takes over. Spectra of fewer than 2 hws + 1 samples have none.
    """
    n = len(y)
    if n < 2 * hws + 1:
        return np.zeros(0, np.int64)
    values = y.tolist()
    best = int(np.argmax(y[: hws + 1]))
    out = []
    for i in range(n):
        low, high = max(0, i - hws), min(n - 1, i + hws)
        if best < low:
            best = low + int(np.argmax(y[low : high + 1]))
        elif values[high] >= values[best]:
            best = high
        if best == i and values[i] > threshold:
            out.append(i)
    return np.array(out, np.int64)


def upper_median(y: np.ndarray) -> float:
    return float(np.partition(y, len(y) // 2)[len(y) // 2])


def mad(y: np.ndarray) -> float:
    return 1.4826 * upper_median(np.abs(y - upper_median(y))) if len(y) else 0.0


def half_width(x: np.ndarray, y: np.ndarray, at: int) -> float:
    """Full width at half maximum of the peak at position `at`, by linear interpolation.

    A side over twice as long as the other counts as long as the other, as does one that never falls to half height (where
    both never do, the width is 0).
    """
    half = y[at] / 2

    def crossing(step: int) -> float | None:
        i = at
        while 0 <= i < len(y) and y[i] > half:
            i += step
        if not 0 <= i < len(y):
            return None
        j = i - step
        return abs(x[i] + (x[j] - x[i]) * (half - y[i]) / (y[j] - y[i]) - x[at])

    left, right = crossing(-1), crossing(1)
    if left is None and right is None:
        return 0.0
    left, right = (right if left is None else left), (left if right is None else right)
    if left > 2 * right:
        return 2 * right
    return 2 * left if right > 2 * left else left + right
