import numpy as np
import pytest
from pyspark.sql import functions as F

from spectroloom.functions.mass import PROTON, RESIDUE_MASS
from spectroloom.functions.numeric import averagine_envelope
from spectroloom.operators import evidence


def peaks_of(mass, charge, scans, height, envelope):
    return [("r", s, float((mass + i * 1.00335483) / charge + PROTON), float(height * x)) for s in scans for i, x in enumerate(envelope)]


def test_feature_matrix_and_growth(spark):
    e = averagine_envelope(5000.0)
    peaks = spark.createDataFrame([p for z in (5, 6, 7) for p in peaks_of(5000.0, z, range(10, 16), 100.0 * z, e)] + peaks_of(5000.0, 6, range(40, 42), 10.0, e), "run string, scan_num int, mz double, intensity double")
    masses = spark.createDataFrame([(1, 5000.0, e.tolist()), (2, 7777.0, averagine_envelope(7777.0).tolist())], "mass_id int, mass double, envelope array<double>")
    matrix = evidence.feature_matrix(masses, peaks, (3, 10), 5.0)
    rows = matrix.where("mass_id = 1 and corr > 0.99").collect()
    assert {(r["charge"], r["scan_num"]) for r in rows} == {(z, s) for z in (5, 6, 7) for s in range(10, 16)} | {(6, 40), (6, 41)}
    assert all(r["dist"] < 1e-6 for r in rows)
    found = evidence.grow_clusters(matrix, masses).where("mass_id = 1").orderBy(F.desc("abundance")).first()
    assert (found["min_charge"], found["max_charge"], found["min_scan"]) == (5, 7, 10)
    match = spark.createDataFrame([(9, 1, 12), (8, 1, 300)], "match_id int, mass_id int, scan int")
    got = {r["match_id"]: r["ms1_corr"] for r in evidence.ms1_evidence(match, matrix, ["match_id"], "scan", 3).collect()}
    assert got[9] == pytest.approx(1) and got[8] == 0


def test_harmonics_go(spark):
    df = spark.createDataFrame([(1, 10000.0, 10, 100.0), (1, 5000.0, 5, 20.0), (1, 20000.0, 20, 10.0), (1, 5000.0, 7, 20.0), (2, 5000.0, 5, 20.0)], "scan int, mass double, charge int, intensity double")
    left = sorted((r["scan"], r["mass"], r["charge"]) for r in evidence.without_harmonics(df, ["scan"], 10.0).collect())
    assert left == [(1, 5000.0, 7), (1, 10000.0, 10), (2, 5000.0, 5)]


def test_reachable_bins():
    steps = sorted({int(round(m * 0.9995)) for m in RESIDUE_MASS.values()})
    want = {0}
    for m in range(1, 401):
        if any(m - s in want for s in steps):
            want.add(m)
    assert evidence.reachable_bins(400).tolist() == sorted(want)


def test_tag_extension(spark):
    proteins = spark.createDataFrame([("P", "MAGKPEPTLDESR")], "name string, sequence string")
    mass = lambda s: sum(RESIDUE_MASS[r] for r in s)
    hits = spark.createDataFrame([("P", 4, "PEPTL", mass("AGK"), mass("DES") + 15.994915)], "name string, position int, tag string, before double, after double")
    got = evidence.extended_tags(hits, proteins, "name", "sequence", "position", "tag", "before", "after", 0.01, (0.0, 15.994915)).collect()
    assert [(r["matched"], r["left_shift"], r["right_shift"], r["start"], r["stop"]) for r in got] == [("AGKPEPTLDES", 0.0, 15.994915, 1, 12)]


def test_apex(spark):
    df = spark.createDataFrame([("a", k, float(v), 2) for k, v in enumerate([0, 1, 2, 9, 3, 1, 7, 0])], "k string, at int, i double, target int")
    assert evidence.apexes(df, ["k"], "at", "i", "target").first()["apex"] == 3


def test_quick_counts_prefers_more_bins(spark):
    proteins = spark.createDataFrame([(1, "GGGG"), (2, "GASP")], "id int, sequence string")
    m = np.cumsum([RESIDUE_MASS[r] for r in "GAS"]).tolist()
    peaks = spark.createDataFrame([(7, float(x)) for x in m], "scan int, mass double")
    assert [tuple(r) for r in evidence.quick_counts(proteins, peaks, "id", "sequence", "scan", "mass").collect()] == [(7, 2, 3)]
