"""Similarities, statistics and scans over array columns, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Of arrays of equal length; 0 if they are empty or differ in length."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same, dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))).otherwise(F.lit(0.0))


def _moments(a: Column, b: Column) -> Column:
    """cov, var a, var b as sums about the means, in one pass over centred pairs."""
    pair = F.struct(mean(a).alias("ma"), mean(b).alias("mb"))
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    centred = F.transform(F.array(pair), lambda m: F.aggregate(F.zip_with(a, b, lambda x, y: F.struct((x - m["ma"]).alias("x"), (y - m["mb"]).alias("y"))), zero, lambda s, p: F.struct((s["c"] + p["x"] * p["y"]).alias("c"), (s["a"] + p["x"] * p["x"]).alias("a"), (s["b"] + p["y"] * p["y"]).alias("b"))))
    return centred[0]


def pearson(a: Column, b: Column) -> Column:
    """Negative and undefined correlations are 0; a single pair is 1; unequal lengths are 0."""
    m = _moments(a, b)
    value = F.when((m["a"] > 0) & (m["b"] > 0) & (m["c"] > 0), m["c"] / F.sqrt(m["a"] * m["b"])).otherwise(F.lit(0.0))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).when(F.size(a) == 1, F.lit(1.0)).otherwise(value)


def bhattacharyya(a: Column, b: Column) -> Column:
    """-log of the overlap of two profiles; infinite if one has no positive sum, 0 for empty ones."""
    sa, sb = total(a), total(b)
    overlap = total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y))) / F.sqrt(sa * sb)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).when((sa > 0) & (sb > 0), -F.log(overlap)).otherwise(F.lit(float("inf")))


def kl_divergence(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: x * F.log(x / y)))


def max_normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.array_max(a))


def argmax(a: Column) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(a, F.array_max(a)) - 1


def top3_window(a: Column) -> Column:
    """The maximum and its neighbours: from one before it (or the start) three values on."""
    return F.slice(a, F.greatest(argmax(a), F.lit(1).cast("long")).cast("int"), F.lit(3))


def upper_quantile(a: Column, share: float = 0.875) -> Column:
    """The value at ``share`` of the ascending order, not interpolated."""
    return F.element_at(F.array_sort(a), F.least(F.floor(F.size(a) * share) + 1, F.size(a)).cast("int"))


def upper_median(a: Column) -> Column:
    """The value at n // 2 of the descending order."""
    return F.element_at(F.sort_array(a, asc=False), (F.floor(F.size(a) / 2) + 1).cast("int"))


def sample_variance(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean(a)) * (x - mean(a))) / (F.size(a) - 1)


def max_subarray(a: Column) -> Column:
    """Struct (best, start, length) of the contiguous run with the largest sum; first wins."""
    zero = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0.0).alias("run"), F.lit(0).alias("since"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        fresh = s["run"] <= 0
        run = F.when(fresh, x).otherwise(s["run"] + x)
        since = F.when(fresh, s["i"]).otherwise(s["since"])
        better = run > s["best"]
        return F.struct(F.when(better, run).otherwise(s["best"]).alias("best"), F.when(better, since).otherwise(s["start"]).alias("start"), F.when(better, s["i"] - since + 1).otherwise(s["length"]).alias("length"), run.alias("run"), since.alias("since"), (s["i"] + 1).alias("i"))

    done = F.aggregate(F.transform(a, lambda x: x.cast("double")), zero, step)
    return F.struct(done["best"].alias("best"), done["start"].alias("start"), done["length"].alias("length"))


def running_sum(a: Column) -> Column:
    """Prefix sums of an array of doubles."""
    start = F.array().cast("array<double>")
    return F.aggregate(a, start, lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x)))
