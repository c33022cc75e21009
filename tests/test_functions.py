import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectroloom.functions import arrays, mass, numeric, text


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first()


def test_bits_of_floats(spark):
    rng = random.Random(1)
    values = [rng.uniform(50, 1e5) for _ in range(500)] + [2.0**k for k in range(6, 17)] + [math.nextafter(2.0**k, 0) for k in range(6, 17)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", mass.float_bits_bin(F.col("v")).alias("b"))
    for v, b in df.collect():
        assert b == int(np.float64(v).view(np.int64)) >> (64 - 27)
    assert mass.ppm_of_bits(28) == 8 and mass.bits_for_ppm(16) == 27 and mass.bits_for_ppm(4) == 29


def test_half_to_even(spark):
    assert list(one(spark, mass.nominal_bin(F.lit(2.5 / 0.9995)), mass.nominal_bin(F.lit(3.5 / 0.9995)))) == [2, 4]


def test_isotopes_and_charges(spark):
    mz = mass.isotope_mz(F.lit(10000.0), F.lit(10), F.lit(3))
    assert one(spark, mass.mono_mass(mz, F.lit(10), F.lit(3)))[0] == pytest.approx(10000)
    assert one(spark, mass.charge_span(F.lit(10000.0), 600.0, 2000.0))[0] == list(range(6, 17))
    assert one(spark, mass.charge_span(F.lit(100.0), 600.0, 2000.0))[0] is None


def test_compositions_and_masses(spark):
    atoms = one(spark, mass.residue_atoms(F.lit("PEPTIDE")))[0].asDict()
    assert atoms == {"C": 34, "H": 51, "N": 7, "O": 14, "S": 0}
    assert one(spark, mass.residue_mass(F.lit("PEPTIDE")))[0] + mass.WATER == pytest.approx(799.35996, abs=1e-4)
    r = one(spark, text.parse_composition(F.lit("C(153) H(232) 13C(2) N(-4)")), text.parse_composition(F.lit("C2HO12")))
    assert r[0] == {"C": 153, "H": 232, "13C": 2, "N": -4} and r[1] == {"C": 2, "H": 1, "O": 12}
    assert one(spark, text.format_composition(text.add_compositions(text.parse_composition(F.lit("C2H")), text.parse_composition(F.lit("H3O")))))[0] == "C(2) H(4) O(1)"


def test_text(spark):
    r = one(spark, text.between_dots(F.lit("K.PEP.TIDE.R")), text.between_dots(F.lit("x.y")), text.decoy_reverse(F.lit("MAKCDEFRGH"), "KR"), text.native_id_value(F.lit("a=1 scan=77"), "scan"), text.build_date(F.lit("1.0.7030.5")))
    assert list(r)[:4] == ["PEP.TIDE", "x.y", "AMKFEDCRHG", "77"] and str(r[4]) == "2019-04-01"
    shuffled = one(spark, text.decoy_shuffle(F.lit("PEPTIDEK"), F.lit(3)))[0]
    assert sorted(shuffled) == sorted("PEPTIDEK")
    mods = one(spark, text.parse_modifications(F.lit("Oxidation 5,Acetyl (N) 0")), text.parse_modifications(F.lit("")))
    assert [tuple(m) for m in mods[0]] == [("Oxidation", 5), ("Acetyl (N)", 0)] and mods[1] == []
    assert tuple(one(spark, text.parse_ion(F.lit("y12-H2O(2+)")))[0]) == ("y", 12, "-H2O", 2)
    r = one(spark, mass.tolerance_value(F.lit("10ppm")), mass.tolerance_unit(F.lit("10ppm")), mass.tolerance_value(F.lit(".5 Da")), mass.tolerance_unit(F.lit(".5 Da")), mass.tolerance_value(F.lit("none")))
    assert list(r) == [10.0, "ppm", 0.5, "da", None]


def array(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_similarities(spark):
    a, b, down, flat = array(1, 2, 3), array(2, 4, 6), array(3, 2, 1), array(1, 1, 1)
    r = one(spark, arrays.pearson(a, b), arrays.pearson(a, down), arrays.pearson(a, flat), arrays.cosine(a, b), arrays.bhattacharyya(a, b), arrays.bhattacharyya(a, array(0, 0, 0)), arrays.pearson(array(1), array(5)), arrays.cosine(a, array(1)))
    assert r[0] == pytest.approx(1) and r[1] == 0 and r[2] == 0 and r[3] == pytest.approx(1) and abs(r[4]) < 1e-12 and math.isinf(r[5]) and r[6] == 1 and r[7] == 0
    r = one(spark, arrays.max_subarray(array(-2, 1, -3, 4, -1, 2, 1, -5, 4)), arrays.top3_window(array(1, 5, 3, 2)), arrays.top3_window(array(9, 5, 3, 2)), arrays.upper_median(array(1, 2, 3, 4)), arrays.running_sum(array(1, 2, 3)), arrays.sample_variance(array(1, 2, 3, 4)))
    assert tuple(r[0]) == (6.0, 3, 4) and r[1] == [1, 5, 3] and r[2] == [9, 5, 3] and r[3] == 2 and r[4] == [1, 3, 6] and r[5] == pytest.approx(5 / 3)


def test_envelopes():
    e = numeric.isotope_envelope(83, 124, 23, 24, 0)
    assert e[0] == 1 and e[1] == pytest.approx(0.99612) and len(e) == 4
    big = numeric.averagine_envelope(20000)
    assert 11 <= big.argmax() <= 13 and (big[big.argmax() :] >= 0.1).all()


def test_p_values():
    assert numeric.hypergeometric_p(10, 5, 4, 2) == pytest.approx(1 - (5 + 50 + 100) / 210)
    assert numeric.hypergeometric_p(5, 5, 3, 1) == 1.0
    assert numeric.rank_sum_p(20, 10, 105) == pytest.approx(0.5)
    assert numeric.poisson_p(2.0, 0) == pytest.approx(1 - math.exp(-2))


def test_splines():
    x = np.array([0.0, 1, 2, 4, 5])
    y = 2 * x + 1
    assert np.allclose(numeric.spline_slopes(x, y), 2)
    assert np.allclose(numeric.spline_at(x, y, np.array([0.5, 3, 4.7])), [2, 7, 10.4])
    wave = np.sin(np.linspace(0, 3, 40))
    assert abs(numeric.spline_at(np.linspace(0, 3, 40), wave, np.array([1.234]))[0] - math.sin(1.234)) < 1e-4


def test_apex_and_tuning():
    assert numeric.nearest_apex(np.array([0, 1, 2, 8, 2, 1, 0, 3, 0.0]), 1) == 3
    observed = numeric.isotope_envelope(50, 80, 10, 12, 1)
    v, r = numeric.best_concentration(observed, (50, 80, 10, 12, 1), "C", np.arange(0.009, 0.0131, 0.0001))
    assert abs(v - 0.0107) < 2e-4 and r > 0.999


def test_per_spectrum_udfs(spark):
    df = spark.createDataFrame([([float(k) for k in range(20)], [1.0] * 10 + [100.0 + k for k in range(10)])], "mz array<double>, intensity array<double>")
    r = df.select(numeric.slope_filter_udf("mz", "intensity").alias("s"), numeric.gaussian_udf("intensity").alias("g"), numeric.histogram_noise_udf("mz", "intensity").alias("h")).first()
    assert len(r["s"]) == len(r["g"]) == 20 and r["h"] == [False] * 10 + [True] * 10
