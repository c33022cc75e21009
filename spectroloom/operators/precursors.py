"""From MS1 spectra to the masses that a fragment spectrum can be of, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.functions.arrays import argmax, pearson
from spectroloom.functions.mass import C13_MINUS_C12, PROTON, fine_bin
from spectroloom.functions.numeric import envelope_of_mass
from spectroloom.operators.deconvolution import isotope_peaks
from spectroloom.operators.joins import band_join
from spectroloom.operators.ranking import top_k


def isolated_peaks(scans: DataFrame, ms1_peaks: DataFrame) -> DataFrame:
    """(scan_num, ms1_scan, mz, intensity): MS1 peaks inside a fragment scan's isolation window, in the MS1 scans before and behind it.

    ``scans``: scan_num, low_mz, high_mz, prev_at, next_at (null: none); ``ms1_peaks``: ms1_scan, mz, intensity.
    """
    around = scans.select("scan_num", "low_mz", "high_mz", F.explode(F.array_distinct(F.array_compact(F.array("prev_at", "next_at")))).alias("ms1_scan"))
    return around.join(ms1_peaks, "ms1_scan").where((F.col("mz") >= F.col("low_mz")) & (F.col("mz") <= F.col("high_mz"))).select("scan_num", "ms1_scan", "mz", "intensity")


def precursor_candidates(scans: DataFrame, ms1_peaks: DataFrame, charges: tuple[int, int], ppm: float, top: int | None = None) -> DataFrame:
    """(scan_num, ms1_scan, mz, intensity, charge, mass): isolated peaks with a next isotope at some charge.

    Of each fragment scan the ``top`` strongest isolated peaks are tried (all by default), the first by m/z of equal
    ones. A peak counts as the most abundant isotope of its mass. Peaks of charge z have a neighbour 1.00335 / z above.
    """
    found = isolated_peaks(scans, ms1_peaks)
    if top is not None:
        found = top_k(found, ["scan_num"], [F.desc("intensity"), F.col("mz"), F.col("ms1_scan")], top)
    each = found.withColumn("charge", F.explode(F.sequence(F.lit(charges[0]), F.lit(charges[1])))).withColumn("_next", F.col("mz") + C13_MINUS_C12 / F.col("charge"))
    other = ms1_peaks.select("ms1_scan", F.col("mz").alias("_mz"))
    paired = band_join(each, other, "_next", "_mz", ppm, "ppm", ["ms1_scan"], "left_semi").drop("_next")
    seen = (F.col("mz") - PROTON) * F.col("charge")
    return paired.withColumn("mass", seen - argmax(envelope_of_mass(seen)) * C13_MINUS_C12)


def correlated_candidates(candidates: DataFrame, ms1_peaks: DataFrame, ppm: float, least: float = 0.7) -> DataFrame:
    """Candidates with ``corr``, whose isotopes correlate with the average envelope of their mass at least so well."""
    ids = ["scan_num", "ms1_scan", "mz", "charge"]
    ions = candidates.select(*ids, F.col("mass").alias("ion_mass"), envelope_of_mass(F.col("mass")).alias("envelope")).distinct()
    seen = isotope_peaks(ions, ms1_peaks, ids, ppm, ["ms1_scan"])
    good = seen.join(ions, ids).select(*ids, pearson(F.col("envelope"), F.col("observed")).alias("corr")).where(F.col("corr") >= least)
    return candidates.join(good, ids)


def several_charges(candidates: DataFrame, least: int = 2) -> DataFrame:
    """Candidates whose mass (by fine bins) is seen at several charges for their scan."""
    binned = candidates.withColumn("mass_bin", fine_bin(F.col("mass")))
    agreed = binned.groupBy("scan_num", "mass_bin").agg(F.count_distinct("charge").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return binned.join(agreed, ["scan_num", "mass_bin"], "left_semi").drop("mass_bin")


def without_repeats(candidates: DataFrame, top: int | None = None) -> DataFrame:
    """One candidate of each scan and fine mass bin, the strongest, and of these the ``top`` of each scan."""
    best = top_k(candidates.withColumn("mass_bin", fine_bin(F.col("mass"))), ["scan_num", "mass_bin"], [F.desc("intensity"), F.col("mz"), F.col("charge")], 1)
    return best if top is None else top_k(best, ["scan_num"], [F.desc("intensity"), F.col("mass_bin")], top)


def candidate_scans(masses: DataFrame, mass: str, candidates: DataFrame, ppm: float, id_columns: Sequence[str]) -> DataFrame:
    """(id_columns, scan_num): fragment scans with a candidate within ``ppm`` of each mass."""
    near = band_join(masses, candidates.select("scan_num", F.col("mass").alias("_mass")), mass, "_mass", ppm, "ppm")
    return near.select(*id_columns, "scan_num").distinct()


def feature_extent(matrix: DataFrame, share: float = 0.1, run: str = "run", scan: str = "scan_num") -> DataFrame:
    """(mass_id, run, apex, min_scan, max_scan, min_charge, max_charge): how far a feature reaches from its apex.

    ``matrix`` has mass_id, run, scan, charge and abundance. The elution profile is the sum over charges, the charge
    profile the sum over the scans that are kept; either goes from its highest point up to where it first falls below
    ``share`` of it (scans or charges that are absent end it too). The first of equal apexes counts.
    """
    def extent(profile: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
        top = profile.groupBy(*by).agg(F.max_by(F.struct(F.col(at).alias("apex"), F.col(value).alias("highest")), F.struct(value, -F.col(at))).alias("t"))
        placed = profile.join(top, by).select(*by, F.col(at).alias("at"), F.col("t.apex").alias("apex"), (F.col(value) < F.col("t.highest") * share).alias("low"))
        ends = placed.groupBy(*by).agg(F.max(F.when(F.col("low") & (F.col("at") < F.col("apex")), F.col("at"))).alias("below"), F.min(F.when(F.col("low") & (F.col("at") > F.col("apex")), F.col("at"))).alias("above"))
        inside = placed.join(ends, by).where((F.col("below").isNull() | (F.col("at") > F.col("below"))) & (F.col("above").isNull() | (F.col("at") < F.col("above"))))
        return inside.groupBy(*by).agg(F.first("apex").alias("apex"), F.min("at").alias("first"), F.max("at").alias("last"))

    by = ["mass_id", run]
    scans = extent(matrix.groupBy(*by, scan).agg(F.sum("abundance").alias("a")), by, scan, "a").withColumnsRenamed({"first": "min_scan", "last": "max_scan"})
    kept = matrix.join(scans, by).where(F.col(scan).between(F.col("min_scan"), F.col("max_scan"))).groupBy(*by, "charge").agg(F.sum("abundance").alias("a"))
    charges = extent(kept, by, "charge", "a").select(*by, F.col("first").alias("min_charge"), F.col("last").alias("max_charge"))
    return scans.join(charges, by)
