"""From isotope peaks to masses: deconvolution of spectra and targeted look-ups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectroloom.functions.mass import C13_MINUS_C12, PROTON
from spectroloom.functions.numeric import averagine_envelope
from spectroloom.operators.joins import band_join


def _similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Overlap distance and correlation (not below 0) of two profiles."""
    sa, sb = a.sum(), b.sum()
    if not sa > 0 or not sb > 0:
        return 1.0, 0.0
    distance = -np.log(max(np.sqrt(a / sa * b / sb).sum(), 1e-300))
    da, db = a - a.mean(), b - b.mean()
    cov, va, vb = (da * db).sum(), (da * da).sum(), (db * db).sum()
    return float(distance), float(cov / np.sqrt(va * vb)) if cov > 0 and va > 0 and vb > 0 else 0.0


def deconvolute_spectrum(mz: np.ndarray, intensity: np.ndarray, charges: tuple[int, int], ppm: float, offset: int, least_corr: float, most_distance: float, half_window: float) -> list[tuple]:
    """(mass, charge, intensity, corr, distance) of local maxima that some charge and isotope offset explain.

    For each charge the best offset counts; it is kept if the correlation is high enough or the
    distance low enough.
    """
    order = np.argsort(mz)
    mz, intensity = mz[order], intensity[order]
    out = []
    envelopes: dict[int, np.ndarray] = {}
    for i in range(len(mz)):
        a, b = np.searchsorted(mz, mz[i] - half_window), np.searchsorted(mz, mz[i] + half_window, "right")
        if intensity[i] < intensity[a:b].max():
            continue
        for z in range(charges[0], charges[1] + 1):
            key = int(round((mz[i] - PROTON) * z * 0.9995))
            if key <= 0:
                continue
            if key not in envelopes:
                envelopes[key] = averagine_envelope(key / 0.9995)
            model = envelopes[key]
            top = int(model.argmax())
            best = None
            for shift in range(-offset, offset + 1):
                mass = (mz[i] - PROTON) * z - (top + shift) * C13_MINUS_C12
                if mass <= 0:
                    continue
                expected = (mass + np.arange(len(model)) * C13_MINUS_C12) / z + PROTON
                lo, hi = np.searchsorted(mz, expected * (1 - ppm / 1e6)), np.searchsorted(mz, expected * (1 + ppm / 1e6), "right")
                seen = np.array([intensity[x:y].max() if y > x else 0.0 for x, y in zip(lo, hi, strict=True)])
                if (seen > 0).sum() < min(3, len(model)):
                    continue
                distance, corr = _similarity(model, seen)
                if best is None or corr > best[3]:
                    best = (float(mass), z, float(seen.sum()), corr, distance)
            if best and (best[3] >= least_corr or best[4] <= most_distance):
                out.append(best)
    return out


DECONVOLUTED = "mass double, charge int, intensity double, corr double, dist double"


def deconvolute(spectra: DataFrame, keys: list[str], charges: tuple[int, int] = (1, 20), ppm: float = 10.0, offset: int = 2, least_corr: float = 0.7, most_distance: float = 0.03, half_window: float = 1.1) -> DataFrame:
    """Deconvoluted peaks of spectra (arrays mz and intensity), one row each, a spectrum at a time."""
    schema = ", ".join(f"{k} {spectra.schema[k].dataType.simpleString()}" for k in keys) + ", " + DECONVOLUTED

    def run(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                head = [getattr(row, k) for k in keys]
                found = deconvolute_spectrum(np.asarray(row.mz, float), np.asarray(row.intensity, float), charges, ppm, offset, least_corr, most_distance, half_window) if row.mz is not None and len(row.mz) else []
                rows += [head + list(f) for f in found]
            yield pd.DataFrame(rows, columns=[*keys, "mass", "charge", "intensity", "corr", "dist"])

    return spectra.select(*keys, "mz", "intensity").mapInPandas(run, schema)


def nearest_mass(targets: DataFrame, peaks: DataFrame, target_mass: str, id_columns: list[str], ppm: float, keys: list[str], apart: Column | None = None, gap: Column | None = None) -> DataFrame:
    """Each target with the deconvoluted peak nearest to its mass, within ``ppm``.

    ``apart`` and ``gap`` are the distances that ``ppm`` and the nearest go by, |mass - target| if they are not given:
    of peaks as near on either side the rounding of this difference decides.
    """
    pairs = band_join(targets, peaks, target_mass, "mass", ppm, "ppm", keys, apart=apart)
    nearest = F.min(F.struct((F.abs(F.col("mass") - F.col(target_mass)) if gap is None else gap).alias("gap"), F.col("mass"), F.col("charge"), F.col("intensity"))).alias("n")
    return pairs.groupBy(*id_columns).agg(nearest).select(*id_columns, "n.mass", "n.charge", "n.intensity")


def isotope_peaks(ions: DataFrame, peaks: DataFrame, id_columns: list[str], ppm: float, keys: list[str], mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """Ions (ion_mass, charge, envelope) with ``observed``: the strongest peak's intensity at each isotope, 0 where none is.

    Ions whose most abundant isotope has no peak are left out.
    """
    isotope = F.posexplode("envelope").alias("isotope", "ratio")
    each = ions.select(*id_columns, *[k for k in keys if k not in id_columns], "ion_mass", "charge", F.size("envelope").alias("n"), (F.array_position("envelope", F.array_max("envelope")) - 1).alias("top"), isotope)
    each = each.withColumn("iso_mz", (F.col("ion_mass") + F.col("isotope") * C13_MINUS_C12) / F.col("charge") + PROTON)
    small = peaks.select(*keys, F.col(mz).alias("_mz"), F.col(intensity).alias("_i"))
    hits = band_join(each, small, "iso_mz", "_mz", ppm, "ppm", keys).groupBy(*id_columns, "n", "top", "isotope").agg(F.max("_i").alias("i"))
    table = hits.groupBy(*id_columns, "n", "top").agg(F.map_from_entries(F.collect_list(F.struct("isotope", "i"))).alias("m"))
    table = table.where(F.map_contains_key("m", F.col("top").cast("int")))
    return table.select(*id_columns, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("observed"))
