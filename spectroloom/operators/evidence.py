"""Evidence around masses: mass-to-scan maps, precursor filters, feature matrices, tag extension, unidentified features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectroloom.functions.arrays import bhattacharyya, pearson
from spectroloom.functions.mass import ION_SERIES, NEUTRAL_LOSS, PROTON, RESIDUE_MASS, fine_bin, isotope_mz, nominal_bin, residue_mass
from spectroloom.functions.numeric import prefix_masses
from spectroloom.operators.chromatograms import correlation
from spectroloom.operators.joins import band_join, interval_join


def mass_scan_map(precursors: DataFrame, mass: str, scan: str, ppm: float) -> DataFrame:
    """(mass_bin, scans): fine mass bins within ``ppm`` of a precursor's mass and their sorted distinct scans."""
    low, high = fine_bin(F.col(mass) * (1 - ppm / 1e6)), fine_bin(F.col(mass) * (1 + ppm / 1e6))
    each = precursors.select(F.col(scan).alias("scan"), F.explode(F.sequence(low, high)).alias("mass_bin"))
    return each.groupBy("mass_bin").agg(F.array_sort(F.collect_set("scan")).alias("scans"))


def scans_of_masses(masses: DataFrame, mass: str, mapped: DataFrame) -> DataFrame:
    """``masses`` with ``scan``, a row for each scan of the mass's bin."""
    return masses.withColumn("mass_bin", fine_bin(F.col(mass))).join(mapped, "mass_bin").select(*masses.columns, F.explode("scans").alias("scan"))


def isolation_scans(precursors: DataFrame, scans: DataFrame, mz: str, target: str) -> DataFrame:
    """Precursors with the scans that isolate them: equal m/z to a tenth, rounded half to even."""
    a = precursors.withColumn("_bin", F.bround(F.col(mz) * 10).cast("long"))
    b = scans.withColumn("_bin", F.bround(F.col(target) * 10).cast("long"))
    return a.join(b, "_bin").drop("_bin")


def ion_peaks(peaks: DataFrame, ions: DataFrame, mz: str, ion_mz: str, ppm: float, keys: Sequence[str] = ()) -> DataFrame:
    """Peaks that some ion explains."""
    return band_join(peaks, ions.select(*keys, ion_mz), mz, ion_mz, ppm, "ppm", keys, "left_semi")


def without_precursor_peaks(peaks: DataFrame, precursors: DataFrame, mz: str, precursor_mz: str, offsets: Sequence[float], da: float, keys: Sequence[str]) -> DataFrame:
    """Peaks that stand at none of ``offsets`` from their scan's precursor."""
    places = precursors.select(*keys, F.explode(F.array(*[F.col(precursor_mz) + o for o in offsets])).alias("_place"))
    return band_join(peaks, places, mz, "_place", da, "da", keys, "left_anti")


def above_noise(peaks: DataFrame, intensity: str, noise: str, ratio: float = 1.4826) -> DataFrame:
    """Peaks at or above ``ratio`` times the noise that the instrument gives for them; peaks without a noise stay."""
    return peaks.where(F.col(noise).isNull() | (F.col(intensity) >= F.col(noise) * ratio))


def with_precursor(ions: DataFrame, ms1_peaks: DataFrame, mass: str, charge: str, mz: str, ppm: float, keys: Sequence[str], isotopes: int = 3) -> DataFrame:
    """Ions of which some of the first isotopes has a peak in the MS1 scan of equal keys."""
    each = ions.withColumn("_iso", F.explode(F.sequence(F.lit(0), F.lit(isotopes - 1)))).withColumn("_mz", isotope_mz(F.col(mass), F.col(charge), F.col("_iso")))
    found = band_join(each, ms1_peaks.select(*keys, mz), "_mz", mz, ppm, "ppm", keys, "left_semi")
    return found.drop("_iso", "_mz").distinct()


def ion_types(spark: SparkSession, series: Sequence[str] = ("a", "b", "c", "x", "y", "z"), losses: Sequence[str] = ("", "-H2O", "-NH3"), charges: tuple[int, int] = (1, 3)) -> DataFrame:
    """Every base series with every neutral loss at every charge: a constant table."""
    rows = [(f"{s}{n}" if z == 1 else f"{s}{z}{n}", s, n, z, ION_SERIES[s][0] == "prefix", ION_SERIES[s][1] - NEUTRAL_LOSS[n]) for s in series for n in losses for z in range(charges[0], charges[1] + 1)]
    return spark.createDataFrame(rows, "ion string, series string, loss string, charge int, is_prefix boolean, offset double")


def reachable_bins(most: float, masses: Sequence[float] = tuple(RESIDUE_MASS.values())) -> np.ndarray:
    """Nominal masses up to ``most`` that some sequence of residues has, ascending."""
    steps = sorted({int(round(m * 0.9995)) for m in masses})
    reached = np.zeros(int(most) + 1, bool)
    reached[0] = True
    for m in range(1, len(reached)):
        reached[m] = any(s <= m and reached[m - s] for s in steps)
    return np.flatnonzero(reached)


def quick_counts(proteins: DataFrame, peaks: DataFrame, protein: str, sequence: str, scan: str, mass: str) -> DataFrame:
    """For each scan the protein with most fragment masses at the scan's nominal peak masses; first by id on ties.

    Of proteins of equal sequence only the first by id can be an answer, so that each sequence meets the peaks once.
    """
    n = F.length(sequence)
    firsts = proteins.where(n > 1).groupBy(sequence).agg(F.min(protein).alias(protein))
    prefixes = firsts.select(protein, F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda k: nominal_bin(residue_mass(F.left(F.col(sequence), k))))).alias("bin")).distinct()
    hits = peaks.select(scan, nominal_bin(F.col(mass)).alias("bin")).distinct().join(prefixes, "bin").groupBy(scan, protein).agg(F.count("*").alias("n_bins"))
    w = Window.partitionBy(scan).orderBy(F.desc("n_bins"), protein)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def feature_matrix(masses: DataFrame, peaks: DataFrame, charges: tuple[int, int], ppm: float, run: str = "run", scan: str = "scan_num") -> DataFrame:
    """(mass_id, run, scan, charge, observed, corr, dist, abundance): observed envelopes of ``masses``
    (mass_id, mass, envelope) at every charge in every MS1 scan where the most abundant isotope has a peak.

    ``peaks`` are (run, scan, mz, intensity). Isotope places are joined to peaks by m/z alone, so
    that work follows the peaks near them.
    """
    iso = F.posexplode("envelope").alias("isotope", "ratio")
    each = masses.select("mass_id", "mass", "envelope", (F.array_position("envelope", F.array_max("envelope")) - 1).alias("top"), iso).withColumn("charge", F.explode(F.sequence(F.lit(charges[0]), F.lit(charges[1]))))
    each = each.withColumn("_place", isotope_mz(F.col("mass"), F.col("charge"), F.col("isotope")))
    hits = band_join(each.select("mass_id", "charge", "isotope", "_place"), peaks.select(run, scan, F.col("mz").alias("_mz"), "intensity"), "_place", "_mz", ppm, "ppm")
    cells = hits.groupBy("mass_id", run, scan, "charge", "isotope").agg(F.max("intensity").alias("i"))
    rows = cells.groupBy("mass_id", run, scan, "charge").agg(F.map_from_entries(F.collect_list(F.struct("isotope", "i"))).alias("m"))
    shape = masses.select("mass_id", "envelope", (F.array_position("envelope", F.array_max("envelope")) - 1).cast("int").alias("top"))
    full = rows.join(shape, "mass_id").where(F.map_contains_key("m", F.col("top")))
    observed = F.transform(F.sequence(F.lit(0), F.size("envelope") - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    full = full.withColumn("observed", observed)
    return full.select("mass_id", run, scan, "charge", "observed", pearson(F.col("envelope"), F.col("observed")).alias("corr"), bhattacharyya(F.col("envelope"), F.col("observed")).alias("dist"), F.aggregate("observed", F.lit(0.0), lambda a, x: a + x).alias("abundance"))


def _profile(rows: np.ndarray, model: np.ndarray) -> tuple[float, float]:
    total = rows.sum(0)
    if not total.sum() > 0:
        return 10.0, 0.0
    overlap = np.sqrt(total / total.sum() * model / model.sum()).sum()
    a, b = total - total.mean(), model - model.mean()
    cov, va, vb = (a * b).sum(), (a * a).sum(), (b * b).sum()
    return float(-np.log(max(overlap, 1e-300))), float(cov / np.sqrt(va * vb)) if cov > 0 and va > 0 and vb > 0 else 0.0


# How far growth reaches, and which cells it takes whatever they do to the sum.
GROW_CHARGES, GROW_SCANS, GROW_DISTANCE, GROW_CORRELATION = 4, 2, 0.02, 0.7


def grow_clusters(matrix: DataFrame, masses: DataFrame, run: str = "run", scan: str = "scan_num", seed_corr: float = 0.7) -> DataFrame:
    """(mass_id, run, cluster, min_scan, max_scan, min_charge, max_charge, n_cells, corr, dist, abundance).

    Within a mass and run, seeds go by descending correlation; a cluster takes cells up to 4 charges
    and 2 scans away that are good themselves or improve its summed profile. Cells are taken once.
    """
    joined = matrix.join(masses.select("mass_id", "envelope"), "mass_id")
    kinds = dict(matrix.dtypes)
    schema = f"mass_id {kinds['mass_id']}, {run} {kinds[run]}, cluster int, min_scan long, max_scan long, min_charge int, max_charge int, n_cells int, corr double, dist double, abundance double"

    def within(group: pd.DataFrame) -> pd.DataFrame:
        model = np.asarray(group["envelope"].iloc[0], float)
        scans = sorted(group[scan].unique())
        column = {s: k for k, s in enumerate(scans)}
        cells = {(int(z), column[s]): (np.asarray(o, float), float(c), float(d)) for z, s, o, c, d in group[["charge", scan, "observed", "corr", "dist"]].itertuples(index=False)}
        free, out = dict(cells), []
        for seed in sorted(cells, key=lambda k: (-cells[k][1], k)):
            if seed not in free or cells[seed][1] < seed_corr:
                continue
            taken, todo, total = [], [seed], np.zeros(len(model))
            best = (10.0, 0.0)
            while todo:
                at = todo.pop(0)
                if at not in free:
                    continue
                o, c, d = free[at]
                after = _profile((total + o)[None, :], model)
                if taken and not (d < GROW_DISTANCE or c > GROW_CORRELATION or after[0] < best[0] or after[1] > best[1]):
                    continue
                taken.append(at)
                del free[at]
                total, best = total + o, after
                todo += [(z, s) for z in range(at[0] - GROW_CHARGES, at[0] + GROW_CHARGES + 1) for s in range(at[1] - GROW_SCANS, at[1] + GROW_SCANS + 1) if (z, s) in free]
            zs, ss = [z for z, _ in taken], [scans[s] for _, s in taken]
            out.append([group["mass_id"].iloc[0], group[run].iloc[0], len(out), min(ss), max(ss), min(zs), max(zs), len(taken), best[1], best[0], float(total.sum())])
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return joined.groupBy("mass_id", run).applyInPandas(within, schema)


def without_harmonics(peaks: DataFrame, keys: Sequence[str], ppm: float, mass: str = "mass", charge: str = "charge", intensity: str = "intensity", most: int = 3) -> DataFrame:
    """Deconvoluted peaks without those that a stronger peak of the same spectrum explains at a multiple or
    fraction (up to ``most``) of their charge and mass."""
    strong = peaks.select(*keys, F.col(mass).alias("_m"), F.col(charge).alias("_z"), F.col(intensity).alias("_i"))
    ratios = F.array(*[F.struct(F.lit(float(k)).alias("r")) for k in range(2, most + 1)], *[F.struct(F.lit(1.0 / k).alias("r")) for k in range(2, most + 1)])
    scaled = strong.withColumn("_r", F.explode(F.transform(ratios, lambda s: s["r"]))).withColumn("_want", F.col("_m") * F.col("_r"))
    pairs = band_join(peaks.withColumn("_id", F.xxhash64(*keys, mass, charge, intensity)), scaled, mass, "_want", ppm, "ppm", keys)
    worse = pairs.where((F.col("_i") > F.col(intensity)) & (F.abs(F.col(charge) - F.col("_z") * F.col("_r")) < 0.5)).select("_id").distinct()
    return peaks.withColumn("_id", F.xxhash64(*keys, mass, charge, intensity)).join(worse, "_id", "left_anti").drop("_id")


def charge_consensus(peaks: DataFrame, keys: Sequence[str], least_charges: int = 2, mass: str = "mass", charge: str = "charge", intensity: str = "intensity") -> DataFrame:
    """Masses (fine bins) that several charges of a spectrum agree on, by summed intensity."""
    binned = peaks.withColumn("mass_bin", fine_bin(F.col(mass)))
    return binned.groupBy(*keys, "mass_bin").agg(F.count_distinct(charge).alias("charges"), F.sum(intensity).alias("intensity"), F.avg(mass).alias("mass")).where(F.col("charges") >= least_charges)


def xic_charge_score(points: DataFrame, keys: Sequence[str], scan: str = "scan_num", charge: str = "charge", intensity: str = "intensity") -> DataFrame:
    """keys with the mean correlation of the chromatograms of neighbouring charges, and how many pairs there are."""
    a = points.select(*keys, scan, F.col(charge).alias("_z"), F.col(intensity).alias("_x"))
    b = points.select(*keys, scan, (F.col(charge) - 1).alias("_z"), F.col(intensity).alias("_y"))
    pair = a.join(b, [*keys, scan, "_z"]).groupBy(*keys, "_z").agg(correlation("_x", "_y").alias("_c"))
    return pair.groupBy(*keys).agg(F.avg("_c").alias("charge_correlation"), F.count("*").alias("pairs"))


def ms1_evidence(matches: DataFrame, matrix: DataFrame, by: Sequence[str], scan: str, half: int) -> DataFrame:
    """Matches with ``ms1_corr``: the best correlation of their mass in MS1 scans within ``half`` of theirs, 0 without any."""
    spans = matches.select(*by, "mass_id", F.col(scan).alias("_s")).withColumn("_lo", F.col("_s") - half).withColumn("_hi", F.col("_s") + half)
    near = interval_join(matrix.select("mass_id", F.col("scan_num"), "corr"), spans, "scan_num", "_lo", "_hi", float(2 * half + 1), ["mass_id"])
    best = near.groupBy(*by).agg(F.max("corr").alias("ms1_corr"))
    return matches.join(best, list(by), "left").withColumn("ms1_corr", F.coalesce("ms1_corr", F.lit(0.0)))


def extended_tags(hits: DataFrame, proteins: DataFrame, protein: str, sequence: str, position: str, tag: str, before: str, after: str, da: float, shifts: Sequence[float] = (0.0,)) -> DataFrame:
    """Tags on proteins (0-based ``position``) with the ends that make their flanking masses: ``start`` and
    ``stop`` (0-based, stop excluded) and the mass shifts on either side.

    ``before`` and ``after`` are residue masses on the tag's left and right. Ends are searched among
    all prefixes and suffixes around the tag with each of ``shifts`` (a constant list), by differences of one list of
    prefix masses of each protein.
    """
    masses, n = "_masses", F.length(sequence)
    with_seq = hits.join(proteins.select(protein, sequence, prefix_masses(F.col(sequence)).alias(masses)), protein)
    p = F.col(position).cast("int")
    end = (p + F.length(tag)).cast("int")
    at = lambda i: F.get(masses, i.cast("int"))
    add = F.array(*[F.lit(float(s)) for s in shifts])
    near = lambda mass, wanted: F.exists(add, lambda s: F.abs(mass + s - wanted) <= da)
    starts = F.filter(F.sequence(F.lit(0), p), lambda s: near(at(p) - at(s), F.col(before)))
    stops = F.filter(F.sequence(end, n), lambda s: near(at(s) - at(end), F.col(after)))
    both = with_seq.withColumn("start", F.explode(starts)).withColumn("left_shift", F.explode(add)).where(F.abs(at(p) - at(F.col("start")) + F.col("left_shift") - F.col(before)) <= da)
    right = both.withColumn("stop", F.explode(stops)).withColumn("right_shift", F.explode(add)).where(F.abs(at(F.col("stop")) - at(end) + F.col("right_shift") - F.col(after)) <= da).drop(masses)
    return right.withColumn("matched", F.substring(F.col(sequence), F.col("start") + 1, F.col("stop") - F.col("start"))).drop(sequence)


def unidentified(rows: DataFrame, sequence: str, p_value: str, least: float = 0.01) -> DataFrame:
    """Features without a sequence whose p-value is above ``least``."""
    return rows.where((F.coalesce(F.col(sequence), F.lit("")) == "") & (F.col(p_value) > least))


def feature_run_matrix(features: DataFrame, scans: DataFrame, runs: Sequence[str], charges: tuple[int, int] = (2, 60), slack: float = 0.5) -> DataFrame:
    """feature_id with the number of fragment scans of each run that isolate the feature at some charge within its time.

    ``features``: feature_id, mass, min_time, max_time; ``scans``: run, elution_time, low_mz, high_mz.
    """
    inside = interval_join(scans, features, "elution_time", "min_time", "max_time", 1.0)
    each = inside.withColumn("_z", F.explode(F.sequence(F.lit(charges[0]), F.lit(charges[1]))))
    mz = (F.col("mass") + F.col("_z") * PROTON) / F.col("_z")
    hit = each.where((mz >= F.col("low_mz") - slack) & (mz <= F.col("high_mz") + slack)).select("feature_id", "run", "elution_time").distinct()
    counted = hit.groupBy("feature_id").pivot("run", list(runs)).agg(F.count("elution_time"))
    return features.select("feature_id").join(counted, "feature_id", "left").fillna(0)


def apexes(points: DataFrame, keys: Sequence[str], at: str, intensity: str, target: str) -> DataFrame:
    """keys with ``apex``: where hill climbing on three-point sums from the point at ``target`` ends."""
    from spectroloom.functions.numeric import nearest_apex

    schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys) + f", apex {points.schema[at].dataType.simpleString()}"

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(at).reset_index(drop=True)
        start = int((group[at] - group[target].iloc[0]).abs().idxmin())
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), group[at].iloc[nearest_apex(group[intensity].to_numpy(float), start)]]], columns=[*keys, "apex"])

    return points.groupBy(*keys).applyInPandas(within, schema)

