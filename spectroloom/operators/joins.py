"""Joins on bands, intervals, order and bins: equi-joins on buckets with an exact predicate behind.

No join here is a cross join: one side is copied to the two or three buckets that can hold a
partner, so the work follows the number of near pairs. ``keys`` are equi-join columns that both
sides share (a run, a scan).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The right side with its keys and bucket renamed, and the equality of keys and buckets."""
    renamed = right
    condition = F.col("_bucket") == F.col("_rbucket")
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
        condition = condition & (F.col(k) == F.col(f"_r_{k}"))
    return renamed, condition


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tolerance: float, unit: str = "da", keys: Sequence[str] = (), how: str = "inner", strict: bool = False, apart: Column | None = None) -> DataFrame:
    """Pairs with |left - right| <= tolerance (``strict``: <); ``unit`` ppm takes millionths of the left value.

    Buckets are as wide as the tolerance, in logarithms for ppm, where values must be positive.
    ``how``: inner, left, left_semi or left_anti. Null values match nothing. ``apart`` is the distance where it is
    to be rounded like another expression of the same value.
    """
    if unit not in ("da", "ppm"):
        raise ValueError("unit is da or ppm")
    if unit == "ppm":
        # a value and its partners differ by less than log1p(2 ppm), however the ends are rounded
        width = math.log1p(2 * tolerance / 1e6)
        bucket = lambda c: F.floor(F.log(c) / width)
        band = F.col(left_on) * tolerance / 1e6
    else:
        width = tolerance or 1e-9
        bucket = lambda c: F.floor(c / width)
        band = F.lit(float(tolerance))
    gap = F.abs(F.col(left_on) - F.col(right_on)) if apart is None else apart
    near = gap < band if strict else gap <= band
    small, same = _matched(left, right, keys)
    # the right side is copied to the buckets around its own; each left row has one bucket
    small = small.withColumn("_rbucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(F.col(right_on)) + d)))
    out = left.withColumn("_bucket", bucket(F.col(left_on))).join(small, same & near, how)
    return out.drop("_bucket", "_rbucket", *[f"_r_{k}" for k in keys])


def band_links(rows: DataFrame, id_column: str, at: str, tolerance: float, keys: Sequence[str] = ()) -> DataFrame:
    """Links (u, v) with the connected components of all pairs with |at - at| <= tolerance, without making these.

    Rows of a bucket a little narrower than the tolerance are all within it and linked to one of them; buckets are linked
    where the nearest ends of two next to each other (or with an empty one between them) are. One link a row and bucket.
    """
    if not tolerance > 0:
        raise ValueError("tolerance is above 0")
    wide = tolerance * (1 - 1e-9)
    dealt = rows.where(F.col(at).isNotNull()).select(*keys, F.col(id_column).alias("u"), F.col(at).alias("_x"), F.floor(F.col(at) / wide).alias("_bucket"))
    cells = dealt.groupBy(*keys, "_bucket").agg(F.min("u").alias("v"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    inside = dealt.join(cells.select(*keys, "_bucket", "v"), [*keys, "_bucket"]).select("u", "v")
    after = cells.select(*keys, F.explode(F.array(F.col("_bucket") - 1, F.col("_bucket") - 2)).alias("_bucket"), F.col("v").alias("_v"), F.col("_low").alias("_next"))
    between = cells.join(after, [*keys, "_bucket"]).where(F.col("_next") - F.col("_high") <= tolerance).select(F.col("v").alias("u"), F.col("_v").alias("v"))
    return inside.unionByName(between).where("u <> v")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float, keys: Sequence[str] = (), how: str = "inner", closed: str = "both") -> DataFrame:
    """Points inside intervals. ``width`` is a bucket's: about a typical interval's length.

    ``closed``: both ends, low (the low end only) or neither. Intervals are copied to the buckets that they touch. Null
    points and intervals with a null or reversed end match nothing; ties all match.
    """
    if closed not in ("both", "low", "neither"):
        raise ValueError("closed is both, low or neither")
    low_ok = F.col(low) < F.col(at) if closed == "neither" else F.col(low) <= F.col(at)
    high_ok = F.col(at) <= F.col(high) if closed == "both" else F.col(at) < F.col(high)
    renamed, same = _matched(points, intervals.where(F.col(low) <= F.col(high)), keys)
    touched = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    renamed = renamed.withColumn("_rbucket", F.explode(touched))
    out = points.withColumn("_bucket", F.floor(F.col(at) / width)).join(renamed, same & low_ok & high_ok, how)
    return out.drop("_bucket", "_rbucket", *[f"_r_{k}" for k in keys])


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float, slack: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of intervals with left.low - slack < right.high and right.low < left.high + slack, each once.

    Both sides are copied to the buckets they touch; a pair counts in the first one that they share. Intervals with a
    null or reversed end match nothing; ``width`` should be about a usual interval's length, since a row is copied
    length / width times.
    """
    (a, b), (c, d) = left_span, right_span
    renamed, same = _matched(left, right, keys)
    lo, hi = F.floor((F.col(a) - slack) / width), F.floor((F.col(b) + slack) / width)
    lefts = left.withColumn("_first", lo).withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    rights = renamed.withColumn("_rfirst", F.floor(F.col(c) / width)).withColumn("_rbucket", F.explode(F.sequence(F.floor(F.col(c) / width), F.floor(F.col(d) / width))))
    touching = (F.col(a) - slack < F.col(d)) & (F.col(c) < F.col(b) + slack)
    out = lefts.join(rights, same & touching & (F.col("_bucket") == F.greatest("_first", "_rfirst")))
    return out.drop("_bucket", "_rbucket", "_first", "_rfirst", *[f"_r_{k}" for k in keys])


def asof_join(left: DataFrame, right: DataFrame, on: str, keys: Sequence[str], take: Sequence[str], direction: str = "backward", right_on: str | None = None) -> DataFrame:
    """Each left row with the columns ``take`` of the nearest right row before it (or at it), or after.

    One window over the union of both sides, partitioned by ``keys``: no pairs are made. Of several right rows at one
    place any may be taken; left rows with a null place see right rows with a null place only, null keys are one group.
    """
    right_on = right_on or on
    ours = left.withColumn("_left", F.struct(*left.columns)).select(*keys, F.col(on).alias("_at"), "_left", F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_right"))
    theirs = right.select(*keys, F.col(right_on).alias("_at"), F.lit(None).cast(ours.schema["_left"].dataType).alias("_left"), F.struct(*take).alias("_right"))
    both = ours.unionByName(theirs)
    # at equal places the right row is seen from either side
    if direction == "backward":
        w = Window.partitionBy(*keys).orderBy("_at", F.col("_left").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_right", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(*keys).orderBy("_at", F.col("_left").isNull()).rowsBetween(0, Window.unboundedFollowing)
        found = F.first("_right", ignorenulls=True).over(w)
    return both.withColumn("_found", found).where(F.col("_left").isNotNull()).select("_left.*", *[F.col(f"_found.{c}").alias(f"asof_{c}") for c in take])


def previous_and_next(df: DataFrame, at: str, keys: Sequence[str], level: Column) -> DataFrame:
    """``df`` with ``prev_at`` and ``next_at``: the nearest rows before and after where ``level`` holds, null if there
    is none. Rows at equal places are before or after each other in no fixed order."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    mark = F.when(level, F.col(at))
    return df.withColumn("prev_at", F.last(mark, ignorenulls=True).over(before)).withColumn("next_at", F.first(mark, ignorenulls=True).over(after))


def best_in_band(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tolerance: float, best: Column, take: Sequence[str], id_columns: Sequence[str], unit: str = "da", keys: Sequence[str] = ()) -> DataFrame:
    """Each left row's best partner in the band, by the largest ``best``, then the largest ``take``; rows without one are left out."""
    pairs = band_join(left, right, left_on, right_on, tolerance, unit, keys)
    picked = pairs.groupBy(*id_columns).agg(F.max_by(F.struct(*take), F.struct(best, *[F.col(t) for t in take])).alias("_b"))
    return picked.select(*id_columns, "_b.*")


def substring_join(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, least: int, id_columns: Sequence[str], most_hits: int | None = None) -> DataFrame:
    """(id_columns, pattern columns, position): every place, 0-based, where a pattern of at least ``least``
    letters stands in a text.

    The first ``least`` letters are the key: texts are cut into pieces of that length at every
    place that begins some pattern. ``most_hits`` leaves out patterns with more places than that.
    Pieces are many times what a plan takes them for (the size of the texts' file), so they are never broadcast.
    """
    keyed = patterns.where(F.length(pattern) >= least).withColumn("_key", F.substring(pattern, 1, least))
    last = F.length(text) - least
    places = texts.where(last >= 0).select(*id_columns, text, F.explode(F.sequence(F.lit(0), last)).alias("position"))
    cut = places.withColumn("_cut", F.substring(F.col(text), F.col("position") + 1, F.lit(least)))
    hits = cut.join(keyed.hint("merge"), F.col("_cut") == F.col("_key")).where(F.substring(F.col(text), F.col("position") + 1, F.length(pattern)) == F.col(pattern)).drop("_cut", "_key", text)
    if most_hits is None:
        return hits
    rare = hits.groupBy(F.col(pattern).alias("_p")).count().where(F.col("count") <= most_hits).select("_p")
    return hits.join(rare, F.col(pattern) == F.col("_p"), "left_semi")


def shared_members(left: Column, right: Column) -> Column:
    return F.arrays_overlap(left, right)
