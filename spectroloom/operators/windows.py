"""Window operators: false discovery rates, ranks, gaps, neighbourhoods and smoothing.

Null keys are one group; null intensities come last in ranks and are no maximum; rows that are equal in the order that is
given are ranked in no fixed order, so pass enough columns. Repeated rows are rows of their own. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from spectroloom.operators.scratch import materialised


def running_fdr(df: DataFrame, score: str, decoy: str, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """``df`` with ``fdr`` and ``q_value`` in ascending ``score`` (then ``order``).

    fdr = min(1, decoys so far / targets so far), 1 without targets; q_value is the least fdr from
    a row on. Null scores come first, ties go by ``order``. Sums over the whole order without one
    partition: rows are divided into ranges of score and ``order`` (as many as the session's shuffle
    partitions, so that equal scores are divided too) and written once, windows run within the
    ranges, and a table with a row for each range carries what lies before and behind.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(score).asc(), *order]
    base = df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()).withColumn("_d", F.col(decoy).cast("long"))
    base = materialised(base)
    totals = base.groupBy("_part").agg(F.sum("_d").alias("_dd"), F.sum(1 - F.col("_d")).alias("_tt"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_dd").over(before), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_tt").over(before), F.lit(0)).alias("_t0"))
    here = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    # at most ``parts`` rows are broadcast
    with_fdr = base.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    decoys, targets = F.sum("_d").over(here) + F.col("_d0"), F.sum(1 - F.col("_d")).over(here) + F.col("_t0")
    with_fdr = with_fdr.withColumn("fdr", F.when(targets > 0, F.least(F.lit(1.0), decoys / targets)).otherwise(F.lit(1.0)))
    least = with_fdr.groupBy("_part").agg(F.min("fdr").alias("_m"))
    behind = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    later = least.select(F.col("_part").alias("_p2"), F.min("_m").over(behind).alias("_later"))
    rest = Window.partitionBy("_part").orderBy(*keys).rowsBetween(0, Window.unboundedFollowing)
    out = with_fdr.join(F.broadcast(later), F.col("_part") == F.col("_p2"))
    q = F.least(F.min("fdr").over(rest), F.coalesce("_later", F.lit(1.0)))
    return out.withColumn("q_value", q).drop("_part", "_p", "_p2", "_d", "_d0", "_t0", "_later")


def best_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Fixed value: the q-value of rows for which none can be told.
UNDEFINED_Q = 10.0


def target_decoy_fdr(rows: DataFrame, scan: str, peptide: str, score: str, probability: str, decoy: str, tie: Sequence[Column] = (), several: bool = False) -> DataFrame:
    """Rows that are best of their scan, with ``q_value`` and peptide-level ``pep_q_value``.

    Order: score ascending, probability descending, decoys before equal targets, then ``tie``.
    With ``several`` matches a scan, peptides are judged by all rows, and the scans' further rows
    follow with both values 10, as they have no rate of their own.
    """
    order = [F.col(probability).desc(), F.col(decoy).desc(), *tie]
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(scan).orderBy(F.col(score).asc(), *order)))
    best = materialised(ranked.where("_n = 1").drop("_n"))
    scored = running_fdr(best, score, decoy, order).drop("fdr")
    peptides = best_per(rows if several else best, [peptide], [F.col(score).asc(), *order])
    by_peptide = running_fdr(peptides, score, decoy, order).select(F.col(peptide).alias("_pep"), F.col("q_value").alias("pep_q_value"))
    done = scored.join(by_peptide, F.col(peptide).eqNullSafe(F.col("_pep"))).drop("_pep")
    if not several:
        return done
    further = ranked.where("_n > 1").drop("_n").withColumn("q_value", F.lit(UNDEFINED_Q)).withColumn("pep_q_value", F.lit(UNDEFINED_Q))
    return done.unionByName(further)


def identified_counts(scored: DataFrame, peptide: str, protein: str, decoy: str, most: float = 0.01) -> DataFrame:
    """One row: matches, peptides and proteins of targets with q-values up to ``most``."""
    good = scored.where((F.col("q_value") <= most) & ~F.col(decoy))
    return good.agg(F.count("*").alias("matches"), F.count_distinct(F.when(F.col("pep_q_value") <= most, F.col(peptide))).alias("peptides"), F.count_distinct(protein).alias("proteins"))


def intensity_ranks(df: DataFrame, keys: Sequence[str], intensity: str, tie: Sequence[str], least: float = 0.0) -> DataFrame:
    """``df`` with ``rank`` by descending intensity, 1 first; values up to ``least`` have rank 0."""
    w = Window.partitionBy(*keys).orderBy(F.col(intensity).desc(), *tie)
    return df.withColumn("rank", F.when(F.col(intensity) > least, F.row_number().over(w)).otherwise(0))


def gap_sessions(df: DataFrame, keys: Sequence[str], at: str, most: float) -> DataFrame:
    """``df`` with ``session``: 0, 1, ... counting gaps above ``most`` along ``at``."""
    w = Window.partitionBy(*keys).orderBy(at)
    step = F.when(F.col(at) - F.lag(at).over(w) > most, 1).otherwise(0)
    return df.withColumn("_gap", step).withColumn("session", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def trimmed_around(df: DataFrame, keys: Sequence[str], at: str, target: str, most: float) -> DataFrame:
    """The rows of the session that the row at ``target`` belongs to."""
    sessions = gap_sessions(df, keys, at, most)
    own = F.max(F.when(F.col(at) == F.col(target), F.col("session"))).over(Window.partitionBy(*keys))
    return sessions.withColumn("_own", own).where(F.col("session") == F.col("_own")).drop("_own", "session")


def range_window(keys: Sequence[str], at: str, half: float) -> str:
    """The SQL of a frame of ``half`` on either side of ``at``."""
    return f"(PARTITION BY {', '.join(keys)} ORDER BY {at} RANGE BETWEEN {float(half)!r}D PRECEDING AND {float(half)!r}D FOLLOWING)"


def local_maxima(df: DataFrame, keys: Sequence[str], at: str, intensity: str, half: float) -> DataFrame:
    """Rows with the largest intensity within ``half`` of them; ties all stay."""
    return df.withColumn("_max", F.expr(f"max({intensity}) OVER {range_window(keys, at, half)}")).where(F.col("_max") == F.col(intensity)).drop("_max")


def _by_spectrum(df: DataFrame, keys: Sequence[str], at: str, intensity: str, stays: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of each spectrum that ``stays`` (places in order, intensities -> mask) keeps; a spectrum is one row for it."""

    @F.pandas_udf(ArrayType(BooleanType()))
    def mask(places: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([stays(np.asarray(x, float), np.asarray(y, float)).tolist() for x, y in zip(places, heights, strict=True)])

    rows = F.sort_array(F.collect_list(F.struct(F.col(at).cast("double").alias("at"), F.col(intensity).cast("double").alias("height"), F.struct(*df.columns).alias("row"))))
    spectra = df.groupBy(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)]).agg(rows.alias("_r"))
    kept = spectra.select(F.explode(F.arrays_zip(F.col("_r.row").alias("row"), mask(F.col("_r.at"), F.col("_r.height")).alias("stays"))).alias("x"))
    return kept.where("x.stays").select("x.row.*")


def window_rank_filter(df: DataFrame, keys: Sequence[str], at: str, intensity: str, width: float, keep: int) -> DataFrame:
    """Rows that fewer than ``keep`` rows within width / 2 exceed in intensity; ties do not exceed each other."""

    def stays(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(x, x - width / 2), np.searchsorted(x, x + width / 2, "right")
        return np.array([np.count_nonzero(y[a:b] > v) < keep for a, b, v in zip(low, high, y, strict=True)], bool)

    return _by_spectrum(df, keys, at, intensity, stays)


def local_window_noise(df: DataFrame, keys: Sequence[str], at: str, intensity: str, half: float, ratio: float = 1.4826) -> DataFrame:
    """Rows at or above ``ratio`` times the (upper) median of the distinct intensities within ``half``."""

    def stays(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(x, x - half), np.searchsorted(x, x + half, "right")
        around = (np.unique(y[a:b]) for a, b in zip(low, high, strict=True))
        return np.array([v >= u[len(u) // 2] * ratio for v, u in zip(y, around, strict=True)], bool)

    return _by_spectrum(df, keys, at, intensity, stays)


def global_noise(df: DataFrame, keys: Sequence[str], intensity: str, ratio: float = 1.4826) -> DataFrame:
    """Rows at or above ``ratio`` times the upper median intensity of their group."""
    w = Window.partitionBy(*keys)
    ordered = Window.partitionBy(*keys).orderBy(F.col(intensity).desc())
    place = df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(ordered))
    median = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col(intensity))).over(w)
    return place.withColumn("_m", median).where(F.col(intensity) >= F.col("_m") * ratio).drop("_n", "_r", "_m")


def moving_sum(df: DataFrame, keys: Sequence[str], at: Sequence[str], value: str, half: int = 1, name: str = "smoothed") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*at).rowsBetween(-half, half)
    return df.withColumn(name, F.sum(value).over(w))


#: Weights of a second-order fit over nine points, their sum 231.
SMOOTHING = (-21, 14, 39, 54, 59, 54, 39, 14, -21)


def savitzky_golay(df: DataFrame, keys: Sequence[str], at: Sequence[str], value: str, name: str = "smoothed") -> DataFrame:
    """Second-order smoothing over nine points, zeros beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(*at)
    terms = [(F.lag if k < 0 else F.lead)(value, abs(k), 0.0).over(w) * (c / 231) if k else F.col(value) * (c / 231) for k, c in zip(range(-4, 5), SMOOTHING, strict=True)]
    return df.withColumn(name, sum(terms[1:], terms[0]))


def half_shifted_grids(df: DataFrame, keys: Sequence[str], mz: str, intensity: str, width: float) -> DataFrame:
    """Per (keys, grid, bin) of two grids half a width apart: n, median, highest, n above a tenth of it."""
    start = F.min(mz).over(Window.partitionBy(*keys))
    rows = df.withColumn("_s", start).withColumn("grid", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("mz_bin", F.floor((F.col(mz) - F.col("_s")) / width + F.col("grid") * 0.5).cast("long"))
    top = F.max(intensity).over(Window.partitionBy(*keys, "grid", "mz_bin"))
    rows = rows.withColumn("_top", top)
    return rows.groupBy(*keys, "grid", "mz_bin").agg(F.count("*").alias("n"), F.median(intensity).alias("median"), F.max("_top").alias("highest"), F.count_if(F.col(intensity) > F.col("_top") * 0.1).alias("n_high"))


def prefix_sums(df: DataFrame, keys: Sequence[str], at: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``prefix`` (sum up to a row) and ``suffix`` (sum behind it)."""
    up = Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(*at).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("prefix", F.sum(value).over(up)).withColumn("suffix", F.coalesce(F.sum(value).over(behind), F.lit(0.0)))


def summed_by_time(df: DataFrame, keys: Sequence[str], at: str, value: str, half: float) -> DataFrame:
    """``df`` with sum and count of ``value`` over rows within ``half`` along ``at``."""
    frame = range_window(keys, at, half)
    return df.withColumn("window_sum", F.expr(f"sum({value}) OVER {frame}")).withColumn("window_n", F.expr(f"count(*) OVER {frame}"))
