import numpy as np
import pytest
from pyspark.sql import functions as F

from spectroloom.functions.registry import register
from spectroloom.functions.mass import RESIDUE_MASS
from spectroloom.operators import training
from spectroloom.sources import parameters


def test_score_tables_round_trip(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("1.5\t2\t-3\n0\t4.25\t1\n")
    table = training.read_score_table(spark, str(p), "corr")
    assert sorted((r["mass_bin"], r["bin"], r["score"]) for r in table.collect()) == [(0, 0, 1.5), (0, 1, 2.0), (0, 2, -3.0), (1, 0, 0.0), (1, 1, 4.25), (1, 2, 1.0)]
    training.write_score_table(table, str(tmp_path / "out"))
    assert training.read_score_table(spark, str(tmp_path / "out"), "corr").exceptAll(table).count() == 0


def test_error_table_counts_neighbours_only(spark):
    df = spark.createDataFrame([("a", 1, 100.0, 100.0), ("a", 2, 200.01, 200.0), ("a", 4, 300.0, 300.0)], "k string, cut int, m double, e double")
    assert [(r["bin"], r["n"]) for r in training.mass_error_table(df, ["k"], "cut", "m", "e", 0.02, 4).collect()] == [(3, 1)]


def test_log_ratio(spark):
    t = training.probabilities(spark.createDataFrame([("y", 1, 3), ("y", 2, 1)], "ion string, rank int, n long"), ["ion"])
    d = training.probabilities(spark.createDataFrame([("y", 1, 1), ("y", 3, 1)], "ion string, rank int, n long"), ["ion"])
    got = {r["rank"]: r["score"] for r in training.log_ratio(t, d, ["ion", "rank"]).collect()}
    assert got[1] == pytest.approx(np.log(1.5)) and got[2] == got[3] == 0


def test_significance_prefers_intense_matches(spark):
    rows = [("good", float(i), i >= 30) for i in range(40)] + [("bad", float(i), i < 10) for i in range(40)]
    got = {r["k"]: r for r in training.significance_score(spark.createDataFrame(rows, "k string, i double, hit boolean"), ["k"], "i", "hit").collect()}
    assert got["good"]["rank_score"] > 10 > got["bad"]["rank_score"] and got["good"]["hyper_score"] > got["bad"]["hyper_score"]


def test_scoring_graph():
    starts, ends, names = training.scoring_graph(300)
    assert ends[starts[0] : starts[1]].tolist() == [int(round(m * 0.9995)) for m in RESIDUE_MASS.values()]
    assert starts[2] == starts[1] and len(starts) == 302 and len(names) == len(ends)


def test_linear_and_ion_scores(spark):
    df = spark.createDataFrame([(2.0, None, [1.0, 0.5], [2.0, 1.0])], "a double, b double, envelope array<double>, observed array<double>")
    r = training.ion_scores(training.linear_score(df, {"a": 1.0, "b": 5.0}, -2.0)).first()
    assert (r["raw_score"], r["probability"]) == (0.0, 0.5) and r["corr"] == pytest.approx(1) and r["cosine"] == pytest.approx(1)


def test_smoothed_area_and_map(spark):
    y = np.exp(-0.5 * ((np.arange(60) - 30) / 5.0) ** 2) * 100
    df = spark.createDataFrame([("a", float(k), float(v)) for k, v in enumerate(y)], "k string, at double, i double")
    r = training.smoothed_area(df, ["k"], "at", "i").first()
    assert r["area"] == pytest.approx(100 * 5 * np.sqrt(2 * np.pi), rel=0.02) and r["apex"] == 30
    cells = training.feature_map(df, "at", "i", "i", 100.0, 1000.0).collect()
    assert len(cells) == 1 and cells[0]["log_abundance"] == pytest.approx(np.log10(y.sum()))


def test_sql_functions(spark):
    names = register(spark)
    assert "digest" in names
    r = spark.sql("SELECT isotope_mz(1000D, 2, 1) AS mz, mono_mass(isotope_mz(1000D, 2, 1), 2, 1) AS m, nominal_bin(1000D) AS b, within_ppm(1000D, 1000.001D, 5D) AS w, size(envelope_of_mass(5000D)) AS n").first()
    assert r["m"] == pytest.approx(1000) and r["b"] == 1000 and r["w"] and r["n"] > 3
    got = [tuple(r) for r in spark.sql("SELECT peptide, start, missed FROM digest('MAKCRD', 'KR', 1) ORDER BY start, missed").collect()]
    assert got == [("MAK", 0, 0), ("MAKCR", 0, 1), ("CR", 3, 0), ("CRD", 3, 1), ("D", 5, 0)]
    assert spark.sql("SELECT * FROM fragments('GAS')").count() == 4


def test_parameters_round_trip():
    o = parameters.SearchParameters(min_length=7, tag_search=False, cleavage="enzyme", extra={"residues": "KR"})
    assert parameters.parse_parameters(parameters.format_parameters(o)) == o


def test_command_line(spark, tmp_path):
    from spectroloom.__main__ import main
    from test_sources import FEATURES

    (tmp_path / "a.ms1ft").write_text(FEATURES)
    (tmp_path / "sets.tsv").write_text(f"A\ta.raw\t{tmp_path}/a.ms1ft\nB\tb.raw\t{tmp_path}/a.ms1ft\n")
    main(["align", str(tmp_path / "sets.tsv"), str(tmp_path / "out")], spark)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 3 and "A_Abundance" in lines[0] + lines[1] + lines[2]


def test_enzyme_candidates(spark):
    from spectroloom.operators import search

    p = spark.createDataFrame([("P", "", "MAKCCCRDDD")], "name string, description string, sequence string")
    got = {r["sequence"] for r in search.candidates(p, parameters.SearchParameters(min_length=3, max_length=9, cleavage="enzyme")).collect()}
    assert got == {"MAK", "CCCR", "DDD", "MAKCCCR", "CCCRDDD"}
