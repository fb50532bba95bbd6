"""Column functions on the arrays of a spectrum: all built in, no Python at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row; as a plain expression in a lambda it is computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def tolerance(mz: Column, tol: float, ppm: bool, ppm_unit: float = 10e-6) -> Column:
    """Half width of a window at mz. One "ppm" is 1e-5 by default (Q1), ten times what the word says; pass 1e-6 for a real one."""
    return mz * F.lit(tol * ppm_unit) if ppm else F.lit(float(tol))


def transform_intensity(ints: Column, kind: str) -> Column:
    """log2 and log10 of a + 1, sqrt of a, or none."""
    one = {"log2": lambda a: F.log2(a + 1), "log10": lambda a: F.log10(a + 1), "sqrt": F.sqrt, "none": lambda a: a}[kind]
    return F.transform(ints, one)


def transmittance(ints: Column) -> Column:
    """Absorbance to transmittance in per cent."""
    return F.transform(ints, lambda a: F.pow(F.lit(10.0), -a) * 100)


def subrange(mzs: Column, values: Column, low: Column, high: Column) -> Column:
    """Values whose mz lies in [low, high]."""
    return F.filter(values, lambda _, i: F.get(mzs, i).between(low, high))


def tic(mzs: Column, ints: Column) -> Column:
    """Area by trapezoids; an empty spectrum has 1."""
    steps = F.aggregate(F.sequence(F.lit(1), F.size(ints) - 1), F.lit(0.0), lambda acc, i: acc + (F.get(ints, i) + F.get(ints, i - 1)) * (F.get(mzs, i) - F.get(mzs, i - 1)) / 2)
    return F.when(F.size(ints) == 0, 1.0).when(F.size(ints) == 1, 0.0).otherwise(steps)


def norm_factor(mzs: Column, ints: Column, kind: str, infile: Column | None = None, external: Column | None = None) -> Column:
    """Factor of a spectrum by tic, sum, mean, max, rms, none, internal (in the file) or external (a sidecar)."""
    if kind == "tic":
        return tic(mzs, ints)
    if kind == "sum":
        return total(ints)
    if kind == "mean":
        return total(ints) / F.size(ints)
    if kind == "max":
        return F.array_max(ints)
    if kind == "rms":
        return F.sqrt(total(F.transform(ints, lambda a: a * a)) / F.size(ints))
    if kind == "internal":
        return F.coalesce(infile, F.lit(1.0))
    if kind == "external":
        return F.coalesce(external, F.lit(1.0))
    return F.lit(1.0)


def image_factor(factor: Column, ints: Column) -> Column:
    """The factor as a norm image holds it: 1 for an empty spectrum or one without signal."""
    return F.when((F.size(ints) == 0) | (total(ints) == 0), 1.0).otherwise(factor)


def vector_normalize(ints: Column) -> Column:
    """Divided by the L2 norm, left alone where that is under 1e-12."""
    norm = F.sqrt(total(F.transform(ints, lambda a: a * a)))
    return F.when(norm < 1e-12, ints).otherwise(F.transform(ints, lambda a: a / norm))


def median(values: Column) -> Column:
    """True median (Q3); null of nothing."""
    s, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def mad(values: Column) -> Column:
    """1.4826 times the median distance from the median; both medians are element n // 2 of the sorted values."""
    upper = lambda v: F.get(F.sort_array(v), F.floor(F.size(v) / 2).cast("int"))
    return upper(F.transform(values, lambda a: F.abs(a - upper(values)))) * 1.4826


def pool(values: Column, kind: str) -> Column:
    """Sum, mean, maximum or median; 0 of nothing."""
    by = {"sum": total, "mean": lambda v: total(v) / F.size(v), "maximum": F.array_max, "median": median}[kind]
    return F.when(F.size(values) > 0, by(values)).otherwise(0.0)


def poisson_pattern(x: Column, isotopes: int) -> Column:
    """Poisson weights of 0 to isotopes - 1 extra neutrons at mass x, scaled to sum 1."""
    rate = x * 0.000594 + 0.03091
    weights = F.transform(F.sequence(F.lit(0), F.lit(isotopes - 1)), lambda i: F.pow(rate, i.cast("double")) * F.exp(-rate) / F.factorial(i.cast("int")))
    return F.transform(weights, lambda w: w / total(weights))


def correlation(a: Column, b: Column) -> Column:
    """Pearson r of two arrays by moments."""
    n = F.size(a).cast("double")
    mean = lambda v: total(v) / n
    ab, aa, bb = (mean(F.zip_with(x, y, lambda p, q: p * q)) for x, y in ((a, b), (a, a), (b, b)))
    return (ab - mean(a) * mean(b)) / (F.sqrt(aa - mean(a) * mean(a)) * F.sqrt(bb - mean(b) * mean(b)))
