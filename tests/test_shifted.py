"""Tags grown to either side: against all placements, and long proteins in time."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectroloom.functions.mass import ION_SERIES, RESIDUE_MASS, WATER
from spectroloom.operators import evidence, search, shifted

MODIFICATIONS = {"Ox": (15.994915, "MW"), "Ac": (42.010565, "K")}


def weigh(s):
    return sum(RESIDUE_MASS[r] for r in s)


def slow_side(residues, flank, node, most, shifts, unknown, da):
    """The best (score, -modifications) over all ends and placements of one side."""
    best = None
    for end in range(len(residues) + 1):
        spots = [["", *[m for m, (_, on) in MODIFICATIONS.items() if r in on]] for r in residues[:end]]
        for placed in itertools.product(*spots):
            used = [m for m in placed if m]
            if len(used) > most:
                continue
            rest = flank - weigh(residues[:end]) - sum(MODIFICATIONS[m][0] for m in used)
            if not (any(abs(rest - s) <= da for s in shifts) or (unknown and end == len(residues) and unknown[0] <= rest <= unknown[1])):
                continue
            at = [flank - weigh(residues[:i]) - sum(MODIFICATIONS[m][0] for m in placed[:i] if m) for i in range(1, end)]
            got = (round(float(node(np.array(at))[0].sum()) if at else 0.0, 6), -len(used))
            best = got if best is None else max(best, got)
    return best


def test_best_side_is_the_best_of_all():
    rng, found = random.Random(7), 0
    for _ in range(240):
        residues = "".join(rng.choice("GAMKWS") for _ in range(rng.randrange(0, 7)))
        cut = rng.randrange(0, len(residues) + 1)
        extra = rng.choice([0.0, 15.994915, 42.010565, 31.98983, 77.7])
        flank, whole = weigh(residues[:cut]) + extra, 2000.0
        cuts = [flank - weigh(residues[:i]) - rng.choice([0.0, extra, 15.994915]) for i in range(1, cut)]
        peaks = np.array(sorted([c + ION_SERIES["b"][1] for c in cuts] + [whole - c + ION_SERIES["y"][1] for c in cuts[::2]]))
        ones = np.ones(len(peaks))
        node = shifted.cleavage_scores(peaks, ones, ones, 0 * ones, ("b", "y"), whole, 10.0)
        unknown = rng.choice([None, (-20.0, 100.0)])
        got = shifted.best_side(residues, flank, node, MODIFICATIONS, 2, (0.0,), unknown, 0.01)
        want = slow_side(residues, flank, node, 2, (0.0,), unknown, 0.01)
        assert (got is None) == (want is None)
        if got:
            assert (round(got[0], 6), -sum(map(bool, got[4]))) == want
            assert got[3] == pytest.approx(flank - weigh(residues[: got[2]]) - sum(MODIFICATIONS[m][0] for m in got[4] if m), abs=0.011)
            found += 1
    assert found > 60


def spectrum(sequence, left=0.0, right=0.0, placed=()):
    """b and y fragments of a sequence with masses on its ends and on residues (place, mass)."""
    total, out = weigh(sequence) + left + right + sum(m for _, m in placed), []
    for i in range(1, len(sequence)):
        prefix = weigh(sequence[:i]) + left + sum(m for k, m in placed if k < i)
        out += [prefix + ION_SERIES["b"][1], total - prefix + ION_SERIES["y"][1]]
    return total + WATER, out


def test_two_unknown_shifts_and_a_modification(spark):
    protein = "GASPVTLNDQKEMHFRYWGASPMLK"
    precursor, masses = spectrum(protein, left=133.3, right=-17.1, placed=[(12, 15.994915)])
    scans = spark.createDataFrame([(1, precursor), (2, None)], "scan_num int, precursor_mass double")
    peaks = spark.createDataFrame([(1, m, 5.0) for m in masses] + [(2, None, None)], "scan_num int, mass double, intensity double")
    proteins = spark.createDataFrame([("P", protein), ("Q", "GASPVTLNDQKE"), ("none", None)], "name string, sequence string")
    done = search.tag_search(scans, peaks, proteins, 5, 5, unknown=(-100.0, 200.0), modifications=MODIFICATIONS, most_modifications=1)
    best = done.where("name = 'P'").orderBy(F.desc("score")).first()
    assert (best["sequence"], best["left_shift"], best["right_shift"], best["n_matched"]) == (protein, pytest.approx(133.3, abs=1e-5), pytest.approx(-17.1, abs=1e-5), 2 * (len(protein) - 1))
    assert [i for i, m in enumerate(best["placement"]) if m] == [12] and best["placement"][12] == "Ox"
    assert done.where("scan_num = 2").count() == 0


def test_long_proteins_take_seconds(spark):
    rng = random.Random(1)
    protein = "".join(rng.choice("GASPVTLNDQKEMHFRYW") for _ in range(30_000))
    at, tag = 15_000, protein[15_000:15_005]
    hits = [(1, "P", at, tag, weigh(protein[14_000:at]), weigh(protein[at + 5 : 16_000]))] * 20
    frame = spark.createDataFrame(hits, "scan_num int, name string, position int, tag string, before double, after double")
    proteins = spark.createDataFrame([("P", protein)], "name string, sequence string")
    evidence.extended_tags(frame.limit(1), proteins, "name", "sequence", "position", "tag", "before", "after", 0.01).count()
    began = time.perf_counter()
    rows = evidence.extended_tags(frame, proteins, "name", "sequence", "position", "tag", "before", "after", 0.01, (0.0, 15.994915)).collect()
    assert time.perf_counter() - began < 10
    assert {(r["start"], r["stop"], r["left_shift"], r["right_shift"]) for r in rows if r["start"] == 14_000} >= {(14_000, 16_000, 0.0, 0.0)}
    peaks = spark.createDataFrame([(1, m, 1.0) for m in spectrum(protein[14_000:16_000])[1]], "scan_num int, mass double, intensity double")
    began = time.perf_counter()
    best = shifted.shifted_matches(frame, peaks, proteins).orderBy(F.desc("score")).first()
    assert (best["start"], best["stop"], best["n_matched"]) == (14_000, 16_000, 2 * 1999) and time.perf_counter() - began < 20
