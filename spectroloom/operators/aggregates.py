"""Aggregations: clusters, crosstabs, histograms, thresholds, regressions and frequency tables.

Null keys are one group, null values are left out of sums and counts of values, repeated rows count as often as they
occur, and empty tables give no rows (one row of nulls and zeros where there are no keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_summary(df: DataFrame, keys: Sequence[str], charge: str, scan: str, mass: str, abundance: str) -> DataFrame:
    """Extent, median mass and abundance of each cluster, with its strongest member's scan."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(charge).alias("min_charge"), F.max(charge).alias("max_charge"), F.min(scan).alias("min_scan"), F.max(scan).alias("max_scan"),
        F.median(mass).alias("mass"), F.sum(abundance).alias("abundance"), F.max_by(scan, F.struct(F.col(abundance), -F.col(scan))).alias("rep_scan"),
    )


def crosstab(df: DataFrame, group: Sequence[str], label: str, labels: Sequence, aggregates: dict[str, Column]) -> DataFrame:
    """A row for each group, the aggregates once for each label, absent cells null."""
    return df.groupBy(*group).pivot(label, list(labels)).agg(*[c.alias(n) for n, c in aggregates.items()])


def fixed_histogram(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin: 0 below ``low``, 1..bins, bins + 1 from ``high`` on."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.expr(f"width_bucket({value}, {low!r}D, {high!r}D, {bins})").alias("bin")).agg(F.count("*").alias("n"))


def equal_height(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], bins: int) -> DataFrame:
    """``df`` with ``bin``: its place among ``bins`` groups of equal size within ``keys``."""
    return df.withColumn("bin", F.ntile(bins).over(Window.partitionBy(*keys).orderBy(value, *tie)))


def otsu_threshold(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """The upper edge of the bin that best separates two classes of values, by between-class variance."""
    width = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) < high)).withColumn("bin", F.floor((F.col(value) - low) / width))
    counts = inside.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    c = counts.withColumn("w", F.sum("n").over(up)).withColumn("m", F.sum(F.col("n") * F.col("bin")).over(up)).withColumn("all_w", F.sum("n").over(every)).withColumn("all_m", F.sum(F.col("n") * F.col("bin")).over(every))
    rest = F.col("all_w") - F.col("w")
    gap = F.col("m") / F.col("w") - (F.col("all_m") - F.col("m")) / rest
    c = c.withColumn("between", F.when(rest > 0, F.col("w") * rest * gap * gap).otherwise(F.lit(0.0)))
    return c.groupBy(*keys).agg((F.max_by("bin", F.struct("between", -F.col("bin"))) * width + (low + width)).alias("threshold"), F.max("between").alias("between"))


def regression(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.stddev_pop(y).alias("sd"), F.sqrt(F.avg((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)))).alias("rmsd"))


def sample_statistics(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Mean, sample variance, and the correlation limited to 0..1."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.corr(x, y))).alias("correlation"))


def found_and_total(df: DataFrame, keys: Sequence[str], found: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(found).alias("found"), F.count("*").alias("total"))


def rank_table(df: DataFrame, keys: Sequence[str], rank: str, most: int) -> DataFrame:
    """Counts at each rank; unmatched (null) and later ranks share the last place."""
    place = F.when(F.col(rank).between(1, most), F.col(rank)).otherwise(most + 1)
    return df.groupBy(*keys, place.alias("rank_place")).agg(F.count("*").alias("n"))


def smoothed_ranks(table: DataFrame, keys: Sequence[str], rank: str, value: str, edges: Sequence[int], widths: Sequence[int]) -> DataFrame:
    """``table`` with the mean of its block: ranks up to each edge share blocks of the width beside it."""
    block = None
    for edge, width in sorted(zip(edges, widths, strict=True), reverse=True):
        one = F.struct(F.lit(edge).alias("e"), F.floor((F.col(rank) - 1) / width).alias("b"))
        block = F.when(F.col(rank) <= edge, one).otherwise(block if block is not None else F.struct(F.lit(edge + 1).alias("e"), F.floor((F.col(rank) - 1) / width).alias("b")))
    return table.withColumn("_block", block).withColumn("smoothed", F.avg(value).over(Window.partitionBy(*keys, "_block"))).drop("_block")


def offset_frequencies(df: DataFrame, offset: Column, width: float, bins: int, spectra: str) -> DataFrame:
    """Histogram of offsets within +-width, over the number of spectra."""
    n = df.agg(F.count_distinct(spectra).alias("spectra"))
    rows = df.withColumn("_o", offset).where(F.abs("_o") < width)
    counted = rows.groupBy(F.floor((F.col("_o") + width) * bins / (2 * width)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    # one row is broadcast
    return counted.join(F.broadcast(n)).select("bin", "n", (F.col("n") / F.col("spectra")).alias("frequency"))


def pair_presence(df: DataFrame, keys: Sequence[str], at: str, present: Column) -> DataFrame:
    """Over neighbours along ``at``: how often neither, the first, the second or both are present."""
    w = Window.partitionBy(*keys).orderBy(at)
    pairs = df.withColumn("_a", present).withColumn("_b", F.lead("_a").over(w)).where(F.col("_b").isNotNull())
    kind = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").when(F.col("_b"), "second").otherwise("neither")
    return pairs.groupBy(kind.alias("pair")).agg(F.count("*").alias("n"))


def substring_count(df: DataFrame, length: Column, least: int, most: int) -> DataFrame:
    """How many substrings of least..most letters there are, from lengths alone."""
    top = F.least(length, F.lit(most))
    n = F.when(top >= least, (top - least + 1) * (length + 1) - (top * (top + 1) - least * (least - 1)) / 2).otherwise(0)
    return df.agg(F.sum(n).cast("long").alias("n_substrings"), F.max(length).alias("longest"))


def merged_ranges(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Union of closed integer ranges: overlapping and touching ones become one."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = df.withColumn("_new", F.when(F.col(low) > reach + 1, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(*keys, "_run").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count("*").alias("n")).drop("_run")
