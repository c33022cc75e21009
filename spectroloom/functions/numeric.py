"""Numerical functions that need arrays as a whole: plain numpy, and pandas UDFs over columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

# Isotope abundances of each element, by mass difference 0 to 3.
ABUNDANCE = {"C": (0.9893, 0.0107, 0, 0), "H": (0.999885, 0.000115, 0, 0), "N": (0.99632, 0.00368, 0, 0), "O": (0.99757, 0.00038, 0.00205, 0), "S": (0.9493, 0.0076, 0.0429, 0.0002)}


def isotope_envelope(c: int, h: int, n: int, o: int, s: int, least: float = 0.1, most: int = 100) -> np.ndarray:
    """Relative intensities (the highest is 1) of isotopes, up to the first below ``least`` behind the highest.

    Isotopes of each mass difference are Poisson counts; their sum's distribution is a convolution.
    """
    means = [sum(k * ABUNDANCE[e][d] for e, k in zip("CHNOS", (c, h, n, o, s), strict=True)) for d in (1, 2, 3)]
    size = most
    out = np.zeros(size)
    out[0] = 1.0
    for d, mean in enumerate(means, 1):
        if mean <= 0:
            continue
        k = np.arange((size - 1) // d + 1)
        logs = k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])
        step = np.zeros(size)
        step[k * d] = np.exp(logs)
        out = np.convolve(out, step)[:size]
    top = int(out.argmax())
    behind = np.flatnonzero(out[top:] < out[top] * least)
    return out[: top + int(behind[0])] / out[top] if len(behind) else out / out[top]


def averagine_envelope(mass: float, least: float = 0.1) -> np.ndarray:
    from spectroloom.functions.mass import ATOM_MASS

    unit = {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}
    units = mass / sum(k * ATOM_MASS[a] for a, k in unit.items())
    return isotope_envelope(*(int(round(units * unit[a])) for a in "CHNOS"), least=least)


@F.pandas_udf(ArrayType(DoubleType()))
def envelope_of_mass(mass: pd.Series) -> pd.Series:
    """Averagine envelope; masses of equal nominal value share one."""
    known: dict[int, list[float]] = {}
    out = []
    for m in mass:
        if m is None or not m > 0:
            out.append(None)
            continue
        key = int(round(m * 0.9995))
        if key not in known:
            known[key] = averagine_envelope(key / 0.9995).tolist()
        out.append(known[key])
    return pd.Series(out)


@F.pandas_udf(ArrayType(DoubleType()))
def prefix_masses(sequence: pd.Series) -> pd.Series:
    """Masses of a sequence's first 0, 1, ... residues, in one pass; letters that are no residue weigh nothing."""
    from spectroloom.functions.mass import RESIDUE_MASS

    def sums(s: str | None) -> list[float] | None:
        return None if s is None else np.concatenate([[0.0], np.cumsum([RESIDUE_MASS.get(r, 0.0) for r in s])]).tolist()

    return sequence.map(sums)


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * math.erfc(-(x - mean) / (sd * math.sqrt(2)))


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else float("-inf")


def binomial(n: Column, k: Column) -> Column:
    """Ways to choose k of n as an exact long; 0 where k is negative or above n."""
    ways = F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.lit(1).cast("long"), lambda so_far, i: F.call_function("div", so_far * (n - k + i), i.cast("long")))
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).when(k == 0, F.lit(1).cast("long")).otherwise(ways)


def hypergeometric_p(n: int, k: int, n1: int, k1: int, upper: bool = True) -> float:
    """Of n things k are marked and n1 are drawn: 1 - P(marked draws <= k1), 1 where all are marked."""
    if k >= n:
        return 1.0
    cdf = sum(math.exp(log_choose(k, x) + log_choose(n - k, n1 - x) - log_choose(n, n1)) for x in range(max(0, n1 - (n - k)), k1 + 1))
    cdf = min(1.0, cdf)
    return 1 - cdf if upper else min(cdf, 1 - cdf)


def rank_sum_p(n: float, n1: float, r1: float, upper: bool = True) -> float:
    """Normal approximation of the rank-sum test: n ranks, n1 of them sum to r1."""
    n2 = n - n1
    if n1 <= 0 or n2 <= 0:
        return 1.0
    u = n1 * n2 + n1 * (n1 + 1) / 2 - r1
    cdf = normal_cdf(u, n1 * n2 / 2, math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
    return abs(1 - cdf if upper else min(cdf, 1 - cdf))


def poisson_p(mean: float, k: int) -> float:
    """P(count > k)."""
    return max(0.0, 1 - sum(math.exp(x * math.log(mean) - mean - math.lgamma(x + 1)) for x in range(k + 1))) if mean > 0 else 0.0


@F.pandas_udf(DoubleType())
def hypergeometric_udf(n: pd.Series, k: pd.Series, n1: pd.Series, k1: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_p(*map(int, x)) for x in zip(n, k, n1, k1, strict=True)])


@F.pandas_udf(DoubleType())
def rank_sum_udf(n: pd.Series, n1: pd.Series, r1: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_p(*map(float, x)) for x in zip(n, n1, r1, strict=True)])


@F.pandas_udf(DoubleType())
def poisson_udf(mean: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([poisson_p(float(m), int(x)) for m, x in zip(mean, k, strict=True)])


def spline_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """First derivatives at the knots of the natural cubic spline, by elimination of its tridiagonal system."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    inverse = 1 / np.diff(x)
    rise = np.diff(y) * inverse**2
    low, mid, up, right = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    mid[0], up[0], right[0] = 2 * inverse[0], inverse[0], 3 * rise[0]
    low[-1], mid[-1], right[-1] = inverse[-1], 2 * inverse[-1], 3 * rise[-1]
    low[1:-1], up[1:-1] = inverse[:-1], inverse[1:]
    mid[1:-1], right[1:-1] = 2 * (inverse[:-1] + inverse[1:]), 3 * (rise[:-1] + rise[1:])
    for i in range(1, n):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        right[i] -= w * right[i - 1]
    k = np.zeros(n)
    k[-1] = right[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        k[i] = (right[i] - up[i] * k[i + 1]) / mid[i]
    return k


def spline_at(x: np.ndarray, y: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Values of the natural cubic spline; beyond the ends its last pieces go on."""
    k = spline_slopes(x, y)
    i = np.clip(np.searchsorted(x, to, side="right") - 1, 0, len(x) - 2)
    h, dy = x[i + 1] - x[i], y[i + 1] - y[i]
    t = (to - x[i]) / h
    a, b = k[i] * h - dy, -k[i + 1] * h + dy
    return (1 - t) * y[i] + t * y[i + 1] + t * (1 - t) * (a * (1 - t) + b * t)


@F.pandas_udf(ArrayType(DoubleType()))
def slope_filter_udf(mz: pd.Series, intensity: pd.Series) -> pd.Series:
    """Absolute spline slopes of each spectrum's points, for filters on steepness."""
    return pd.Series([np.abs(spline_slopes(np.asarray(x, float), np.asarray(y, float))).tolist() for x, y in zip(mz, intensity, strict=True)])


@F.pandas_udf(ArrayType(DoubleType()))
def gaussian_udf(values: pd.Series) -> pd.Series:
    """Convolution with a normal kernel of one standard deviation, reaching three, ends renormalised."""
    kernel = np.exp(-0.5 * np.arange(-3, 4) ** 2)
    out = []
    for v in values:
        a = np.asarray(v, float)
        out.append((np.convolve(a, kernel, "same") / np.convolve(np.ones(len(a)), kernel, "same")).tolist() if len(a) >= 7 else a.tolist())
    return pd.Series(out)


@F.pandas_udf(ArrayType(BooleanType()))
def histogram_noise_udf(mz: pd.Series, intensity: pd.Series) -> pd.Series:
    """Which peaks stay: those above the most frequent bin of ten over the log intensities of their spectrum."""
    out = []
    for _, y in zip(mz, intensity, strict=True):
        a = np.log(np.maximum(np.asarray(y, float), 1e-300))
        if not len(a) or a.max() == a.min():
            out.append([True] * len(a))
            continue
        counts, edges = np.histogram(a, 10)
        mode = int(counts.argmax())
        out.append((a > edges[mode + 1]).tolist() if mode < 9 else [True] * len(a))
    return pd.Series(out)


def nearest_apex(intensity: np.ndarray, at: int, half: int = 1) -> int:
    """Position of the local maximum that hill climbing reaches on the (2 half + 1)-point sums."""
    smooth = np.convolve(intensity, np.ones(2 * half + 1), "same")
    while True:
        around = [i for i in (at - 1, at + 1) if 0 <= i < len(smooth)]
        best = max(around, key=lambda i: smooth[i], default=at)
        if not around or smooth[best] <= smooth[at]:
            return at
        at = best


def best_concentration(observed: np.ndarray, atoms: tuple[int, int, int, int, int], element: str, values: np.ndarray) -> tuple[float, float]:
    """The abundance of ``element``'s first heavy isotope whose envelope correlates best, and the correlation."""
    best = (0.0, -1.0)
    for v in values:
        kept = ABUNDANCE[element]
        ABUNDANCE[element] = (1 - v - sum(kept[2:]), float(v), *kept[2:])
        try:
            e = isotope_envelope(*atoms)
        finally:
            ABUNDANCE[element] = kept
        n = min(len(e), len(observed))
        r = float(np.corrcoef(e[:n], observed[:n])[0, 1]) if n > 1 else 0.0
        if r > best[1]:
            best = (float(v), r)
    return best
