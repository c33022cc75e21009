"""A search from spectra to q-values over synthetic runs."""

import random

import pytest
from pyspark.sql import functions as F

from spectroloom.functions.mass import PROTON, RESIDUE_MASS, WATER
from spectroloom.operators import search
from spectroloom.sources.parameters import SearchParameters

SPECTRUM = "scan_num int, ms_level int, isolation struct<mono_mz:double,charge:int,target_mz:double,lower:double,upper:double>, mz array<double>, intensity array<double>"


def peptide(rng, n):
    return "".join(rng.choice("ACDEFGHKLMNPQRSTVWY") for _ in range(n))


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    proteins = [(f"P{i}", "", peptide(rng, rng.randint(12, 16))) for i in range(12)]
    scans, peaks = [], []
    for scan, (_, _, seq) in enumerate(proteins[:8], 1):
        mass = sum(RESIDUE_MASS[r] for r in seq) + WATER
        scans.append((scan, 2, ((mass / 2) + PROTON, 2, 0.0, 1.0, 1.0), [], []))
        prefix = 0.0
        for r in seq[:-1]:
            prefix += RESIDUE_MASS[r]
            peaks += [(scan, prefix, 10.0), (scan, mass - prefix, 12.0)]
        peaks += [(scan, rng.uniform(200, mass), 3.0) for _ in range(5)]
    return spark.createDataFrame(scans, SPECTRUM), spark.createDataFrame(proteins, "name string, description string, sequence string"), spark.createDataFrame(peaks, "scan_num int, mass double, intensity double"), proteins


def test_search_finds_what_was_put_in(spark, case):
    runs, proteins, peaks, known = case
    options = SearchParameters(min_length=8, max_length=30, min_mass=500, max_mass=5000, cleavage="none", keep=3, report=1)
    got = {r["scan_num"]: r for r in search.search(runs, proteins, None, options, peaks).collect()}
    for scan, (name, _, seq) in enumerate(known[:8], 1):
        assert got[scan]["sequence"] == seq and got[scan]["name"] == name and got[scan]["q_value"] == 0.0
        assert got[scan]["e_value"] < 1e-2


def test_trimmed_candidates(spark, case):
    _, proteins, _, known = case
    one = search.candidates(proteins, SearchParameters(min_length=8, max_length=30, cleavage="single"))
    assert one.where(F.col("name") == "P0").count() == 3 * (len(known[0][2]) - 8)


def test_rescoring(spark, case):
    _, _, peaks, known = case
    results = spark.createDataFrame([(1, known[0][2]), (2, "AAAAAAAA")], "Scan int, Sequence string")
    got = {r["Scan"]: r["n_matched"] for r in search.rescore(results, peaks).collect()}
    assert got[1] >= 2 * (len(known[0][2]) - 1) - 2 and (got[2] or 0) <= 4


def test_features_of_spectra(spark):
    from spectroloom.functions.numeric import averagine_envelope

    envelope = averagine_envelope(6000.0)
    mz = [float((6000.0 + i * 1.00335483) / 6 + PROTON) for i in range(len(envelope))]
    rows = [("r", s, 1, s * 0.1, mz, [float(1e4 * x * (s - 4)) for x in envelope]) for s in range(5, 12)]
    runs = spark.createDataFrame(rows, "run string, scan_num int, ms_level int, elution_time double, mz array<double>, intensity array<double>")
    best = search.find_features(runs, (4, 8)).orderBy(F.desc("abundance")).first()
    assert abs(best["mass"] - 6000) < 0.1 and (best["min_scan"], best["max_scan"]) == (5, 11)


def test_search_places_modifications(spark, case):
    _, proteins, _, known = case
    mods = {"Ox": (15.994915, "MW"), "Phos": (79.966331, "STY")}
    extra = [("M1", "", "AGSPEPTMDEYLKSGR"), ("M2", "", "GGMADEFWKLTVPAC")]
    put = {1: (extra[0][2], {10: "Phos", 7: "Ox"}), 2: (extra[1][2], {7: "Ox"}), 3: (known[0][2], {})}
    scans, peaks = [], []
    for scan, (seq, at) in put.items():
        each = [RESIDUE_MASS[r] + (mods[at[i]][0] if i in at else 0.0) for i, r in enumerate(seq)]
        scans.append((scan, 2, ((sum(each) + WATER) / 2 + PROTON, 2, 0.0, 1.0, 1.0), [], []))
        for i in range(1, len(seq)):
            peaks += [(scan, sum(each[:i]), 10.0), (scan, sum(each[i:]) + WATER, 12.0)]
    runs = spark.createDataFrame(scans, SPECTRUM)
    every = proteins.unionByName(spark.createDataFrame(extra, proteins.schema))
    options = SearchParameters(min_length=8, max_length=30, min_mass=500, max_mass=5000, cleavage="none", keep=3, report=1, max_modifications=2)
    got = {r["scan_num"]: r for r in search.search(runs, every, mods, options, spark.createDataFrame(peaks, "scan_num int, mass double, intensity double")).collect()}
    for scan, (seq, at) in put.items():
        assert got[scan]["sequence"] == seq and got[scan]["modifications"] == sorted(at.values())
        assert got[scan]["placement"] == [at.get(i, "") for i in range(len(seq))] and got[scan]["n_matched"] == 2 * (len(seq) - 1)


def test_best_placement_against_enumeration():
    import itertools

    from spectroloom.operators import scoring

    rng, sites = random.Random(3), {"A": "SM", "B": "S"}
    for _ in range(40):
        seq = "".join(rng.choice("SMK") for _ in range(6))
        whole = sorted(rng.choice("AB") for _ in range(rng.randint(0, 2)))
        parts = [tuple(sorted(p)) for k in range(len(whole) + 1) for p in set(itertools.combinations(whole, k))]
        hits = {(i, p): (rng.randint(1, 2), rng.uniform(0, 9)) for i in range(1, 6) for p in parts if rng.random() < 0.4}
        best = None
        for placed in itertools.product(["", "A", "B"], repeat=6):
            if sorted(m for m in placed if m) != whole or any(m and r not in sites[m] for r, m in zip(seq, placed, strict=True)):
                continue
            used = [hits.get((i, tuple(sorted(m for m in placed[:i] if m))), (0, 0.0)) for i in range(1, 6)]
            n = sum(u[0] for u in used)
            if n:
                best = max(best or -1e9, n - 0.05 * sum(u[1] for u in used) / n)
        got = scoring.best_placement(seq, whole, hits, sites, 1.0, -0.05)
        assert (got is None and best is None) or got[0] == pytest.approx(best)
