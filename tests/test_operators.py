import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectroloom.operators import aggregates, deconvolution, features, graph, joins, scoring, sequences, tags, windows

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NUMBERS = st.lists(st.one_of(st.none(), st.floats(-50, 50, width=32)), max_size=25)


@QUIET
@given(NUMBERS, NUMBERS, st.sampled_from([0.0, 0.5, 3.0]))
def test_band_join_is_the_theta_join(spark, a, b, tolerance):
    x = spark.createDataFrame([(i, v) for i, v in enumerate(a)], "i long, x double")
    y = spark.createDataFrame([(i, v) for i, v in enumerate(b)], "j long, y double")
    got = sorted(tuple(r) for r in joins.band_join(x, y, "x", "y", tolerance).select("i", "j").collect())
    assert got == [(i, j) for i, u in enumerate(a) for j, v in enumerate(b) if u is not None and v is not None and abs(u - v) <= tolerance]


@QUIET
@given(st.lists(st.floats(100, 1e5), max_size=25), st.lists(st.floats(100, 1e5), max_size=25), st.sampled_from([10, 5000, 200_000]))
def test_band_join_in_ppm(spark, a, b, ppm):
    b = b + [v * (1 + ppm / 1e6 * 0.999) for v in a[:5]] + [v * (1 - ppm / 1e6 * 0.999) for v in a[:5]]
    x = spark.createDataFrame([(i, v) for i, v in enumerate(a)], "i long, x double")
    y = spark.createDataFrame([(i, v) for i, v in enumerate(b)], "j long, y double")
    got = sorted(tuple(r) for r in joins.band_join(x, y, "x", "y", ppm, "ppm").select("i", "j").collect())
    assert got == [(i, j) for i, u in enumerate(a) for j, v in enumerate(b) if abs(u - v) <= u * ppm / 1e6]


@QUIET
@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(0, 15)), max_size=15), st.lists(st.integers(-40, 40), max_size=20), st.sampled_from(["both", "low", "neither"]))
def test_interval_join(spark, spans, points, closed):
    s = spark.createDataFrame([(i, float(a), float(a + n)) for i, (a, n) in enumerate(spans)], "i long, lo double, hi double")
    p = spark.createDataFrame([(j, float(v)) for j, v in enumerate(points)], "j long, v double")
    got = sorted(tuple(r) for r in joins.interval_join(p, s, "v", "lo", "hi", 4.0, closed=closed).select("i", "j").collect())
    test = {"both": lambda v, a, b: a <= v <= b, "low": lambda v, a, b: a <= v < b, "neither": lambda v, a, b: a < v < b}[closed]
    assert got == [(i, j) for i, (a, n) in enumerate(spans) for j, v in enumerate(points) if test(v, a, a + n)]


@QUIET
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(0, 9)), max_size=15), st.lists(st.tuples(st.integers(-20, 20), st.integers(0, 9)), max_size=15))
def test_overlap_join_gives_each_pair_once(spark, a, b):
    x = spark.createDataFrame([(i, float(v), float(v + n)) for i, (v, n) in enumerate(a)], "i long, lo double, hi double")
    y = spark.createDataFrame([(i, float(v), float(v + n)) for i, (v, n) in enumerate(b)], "j long, lo2 double, hi2 double")
    got = sorted(tuple(r) for r in joins.overlap_join(x, y, ("lo", "hi"), ("lo2", "hi2"), 3.0, 1.0).select("i", "j").collect())
    assert got == [(i, j) for i, (u, n) in enumerate(a) for j, (v, m) in enumerate(b) if u - 1 < v + m and v < u + n + 1]


@QUIET
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_connected_components(spark, edges):
    parent = list(range(41))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    for one_task in (1000, 0):
        got = graph.connected_components(spark.range(41), spark.createDataFrame(edges, "u long, v long"), one_task=one_task).collect()
        assert {r["id"]: r["component"] for r in got} == {i: find(i) for i in range(41)}


@QUIET
@given(st.lists(st.tuples(st.integers(0, 8), st.booleans()), min_size=1, max_size=60))
def test_running_fdr(spark, rows):
    df = spark.createDataFrame([(i, float(s), d) for i, (s, d) in enumerate(rows)], "i long, score double, decoy boolean")
    got = {r["i"]: r["q_value"] for r in windows.running_fdr(df, "score", "decoy", [F.col("decoy").desc(), F.col("i")], parts=4).collect()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], not rows[i][1], i))
    fdr, d, t = [], 0, 0
    for i in order:
        d, t = d + rows[i][1], t + (not rows[i][1])
        fdr.append(min(1.0, d / t) if t else 1.0)
    for k, i in enumerate(order):
        assert got[i] == pytest.approx(min(fdr[k:]))


def test_several_matches_a_scan(spark):
    rows = [(1, "A", 0.1, 0.9, False), (1, "B", 0.2, 0.9, False), (2, "B", 0.3, 0.9, False), (2, "C", 0.3, 0.9, True), (3, "D", 0.5, 0.9, False)]
    df = spark.createDataFrame(rows, "scan int, pep string, e double, p double, decoy boolean").withColumn("protein", F.col("pep"))
    got = {(r["scan"], r["pep"]): (round(r["q_value"], 6), round(r["pep_q_value"], 6)) for r in windows.target_decoy_fdr(df, "scan", "pep", "e", "p", "decoy", several=True).collect()}
    # the decoy of scan 2 comes before its equal target; B's best row is that of scan 1
    assert got == {(1, "A"): (0.0, 0.0), (2, "C"): (0.5, 0.333333), (3, "D"): (0.5, 0.333333), (1, "B"): (10.0, 10.0), (2, "B"): (10.0, 10.0)}
    n = windows.identified_counts(windows.target_decoy_fdr(df, "scan", "pep", "e", "p", "decoy"), "pep", "protein", "decoy", 0.1).first()
    assert tuple(n) == (1, 1, 1)


def test_asof_takes_equal_places(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, at long")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("b", 3, "z")], "k string, at long, v string")
    back = {(r["k"], r["at"]): r["asof_v"] for r in joins.asof_join(left, right, "at", ["k"], ["v"]).collect()}
    ahead = {(r["k"], r["at"]): r["asof_v"] for r in joins.asof_join(left, right, "at", ["k"], ["v"], "forward").collect()}
    assert back == {("a", 1): "x", ("a", 5): "y", ("b", 2): None} and ahead == {("a", 1): "x", ("a", 5): None, ("b", 2): "z"}


def test_merged_ranges_touch(spark):
    df = spark.createDataFrame([(1, 3), (4, 6), (8, 9), (2, 5)], "lo long, hi long").withColumn("k", F.lit(1))
    assert sorted((r["low"], r["high"], r["n"]) for r in aggregates.merged_ranges(df, ["k"], "lo", "hi").collect()) == [(1, 6, 3), (8, 9, 1)]


def test_one_per_run(spark):
    df = spark.createDataFrame([(1, 7, "a", 0.10), (2, 7, "b", 0.11), (3, 7, "a", 0.12), (4, 7, "b", 0.50)], "feature long, component long, run string, net double")
    got = {r["feature"]: r["group_id"] for r in graph.one_per_run(df, "component", "run", "net", "feature", 0.05).collect()}
    assert got[2] in (1, 2, 3) and got[4] == 4 and len({got[1], got[3]}) == 2


def test_proteoforms_respect_shared_sites(spark):
    df = spark.createDataFrame([("p", "SMK")], "id string, sequence string")
    got = {tuple(r["modifications"]) for r in sequences.proteoforms(df, "sequence", {"A": 1.0, "B": 2.0}, {"A": "SM", "B": "S"}, 3).collect()}
    # two sites for A, one for B, and both share the serine
    assert got == {(), ("A",), ("B",), ("A", "A"), ("A", "B")}


def test_generating_function_against_enumeration():
    steps, target = np.array([2, 3]), 12
    nodes = np.zeros(target + 1, int)
    nodes[[3, 5, 8]] = [1, 2, -1]
    low, p = scoring.score_distribution(nodes, steps, np.array([0.5, 0.5]), target)
    want = {}

    def walk(mass, score, weight):
        if mass == target:
            want[score] = want.get(score, 0) + weight
        for s in steps:
            if mass + s <= target:
                walk(mass + s, score + (nodes[mass + s] if mass + s < target else 0), weight * 0.5)

    walk(0, 0, 1.0)
    assert {low + i: x for i, x in enumerate(p) if x} == pytest.approx(want)
    assert scoring.tail_probability(low, p, 2) == pytest.approx(sum(v for k, v in want.items() if k >= 2) / sum(want.values()))


def test_best_path_places_modifications():
    residues = np.array([10.0, 20.0, 30.0])
    score, path = scoring.best_path(residues, [[0.0], [0.0, 5.0], [0.0, 5.0]], np.array([10.0, 35.0, 65.0]), 0.01)
    assert score == 3 and path == [0, 1, 0]


def spectrum(mass, charge, envelope):
    return [((mass + i * 1.00335483) / charge + 1.00727649, float(1000.0 * r)) for i, r in enumerate(envelope)]


def test_deconvolution_finds_masses(spark):
    from spectroloom.functions.numeric import averagine_envelope

    rng = random.Random(3)
    peaks = spectrum(8000.0, 9, averagine_envelope(8000)) + spectrum(5200.0, 4, averagine_envelope(5200)) + [(rng.uniform(600, 1500), 5.0) for _ in range(40)]
    df = spark.createDataFrame([(1, [m for m, _ in peaks], [i for _, i in peaks]), (2, [], [])], "scan_num int, mz array<double>, intensity array<double>")
    found = deconvolution.deconvolute(df, ["scan_num"], (1, 12), 10.0).where("corr > 0.95").collect()
    assert any(abs(r["mass"] - 8000) < 0.1 and r["charge"] == 9 for r in found) and any(abs(r["mass"] - 5200) < 0.1 and r["charge"] == 4 for r in found)


def test_isotope_peaks(spark):
    ions = spark.createDataFrame([(1, 1000.0, 1, [0.5, 1.0, 0.4]), (2, 2000.0, 1, [1.0, 0.9])], "id long, ion_mass double, charge int, envelope array<double>").withColumn("scan", F.lit(1))
    peaks = spark.createDataFrame([(1, m, i) for m, i in spectrum(1000.0, 1, [0.5, 1.0])], "scan int, mz double, intensity double")
    got = {r["id"]: r["observed"] for r in deconvolution.isotope_peaks(ions, peaks, ["id"], 10.0, ["scan"]).collect()}
    assert got == {1: [500.0, 1000.0, 0.0]}


def test_features_and_alignment(spark):
    rows = [("r1", s, 1000.0 + 0.001 * (s % 2), 2, 100.0 + s) for s in range(10, 20)] + [("r1", s, 1500.0, 3, 50.0) for s in range(10, 14)] + [("r1", 90, 1000.0, 2, 7.0)]
    peaks = spark.createDataFrame(rows, "run string, scan_num int, mass double, charge int, intensity double")
    table = features.feature_table(features.peak_clusters(peaks)).collect()
    assert sorted((r["n"], r["min_scan"], r["max_scan"]) for r in table) == [(4, 10, 13), (10, 10, 19)]
    f = spark.createDataFrame([("a", 1, 1000.0, 0.2, 5.0), ("b", 2, 1000.003, 0.203, 6.0), ("b", 3, 1200.0, 0.2, 1.0)], "run string, feature long, mass double, net double, abundance double")
    cross = {r["group_id"]: r.asDict() for r in features.alignment_crosstab(features.aligned(f), ["a", "b"]).collect()}
    both = next(r for r in cross.values() if r["a_Abundance"] and r["b_Abundance"])
    assert (both["a_FeatureId"], both["b_FeatureId"]) == (1, 2) and len(cross) == 2
    groups = features.aligned(f)
    missing = features.missing_cells(groups, spark.createDataFrame([("a",), ("b",)], "run string"), spark.createDataFrame([("a", 1200.0, 0.2, 9.0)], "run string, mass double, net double, intensity double")).collect()
    assert [(r["run"], r["abundance"]) for r in missing] == [("a", 9.0)]


def test_matches_inside_features(spark):
    f = spark.createDataFrame([(1, 1000.0, 10, 20)], "feature long, mass double, min_scan int, max_scan int")
    m = spark.createDataFrame([(1000.01, 10, "EDGE", 9.0), (1000.02, 15, "IN", 5.0), (1000.2, 15, "FAR", 7.0)], "mass double, scan int, sequence string, score double")
    assert [r["sequence"] for r in features.features_with_matches(f, m).collect()] == ["IN"]


def test_tag_paths(spark):
    from spectroloom.functions.mass import RESIDUE_MASS

    masses, m = [100.0], 100.0
    for r in "PEPTLDE":
        m += RESIDUE_MASS[r]
        masses.append(m)
    peaks = spark.createDataFrame([(1, i, x) for i, x in enumerate(masses)], "scan int, node long, mass double")
    found = {r["tag"] for r in tags.tag_paths(tags.tag_edges(peaks, ["scan"], "mass", "node"), ["scan"], 5, 7).collect()}
    assert "PEPTLDE" in found and "EPTLD" in found
    proteins = spark.createDataFrame([(1, "MKPEPTIDER"), (2, "AEDITPEPK")], "id long, sequence string")
    hits = tags.tags_on_proteins(spark.createDataFrame([("PEPTL",)], "tag string"), proteins, "id", "sequence")
    assert sorted((r["id"], r["position"], r["reversed"]) for r in hits.collect()) == [(1, 2, False), (2, 3, True)]


def test_proteoforms_with_many_names_respect_shared_sites(spark):
    names = "ABCDEFGH"
    masses, sites = {m: k + 1.0 for k, m in enumerate(names)}, {m: "S" if m < "D" else "K" if m < "G" else "MS" for m in names}
    df = spark.createDataFrame([("p", "SMKK"), ("q", "GG")], "id string, sequence string")
    got = {(r["id"], tuple(r["modifications"])) for r in sequences.proteoforms(df, "sequence", masses, sites, 3).collect()}

    def placed(word, left):
        return not left or any(r in sites[left[0]] and placed(word[:i] + word[i + 1 :], left[1:]) for i, r in enumerate(word))

    assert got == {(i, c) for i, w in (("p", "SMKK"), ("q", "GG")) for c in sequences.modification_combinations(list(masses), 3) if placed(w, c)}


def components_of(n, linked):
    """Least member reachable, by all pairs."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(n):
            if i != j and linked(i, j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(n)]


def partition(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, set()).add(i)
    return {frozenset(g) for g in groups.values()}


PEAK = "k long, run string, scan_num int, mass double, charge int, intensity double"


def test_clusters_lose_no_link_and_no_row(spark):
    # one later peak at the other edge of the band, behind six nearer ones; and two equal rows
    rows = [(0, "r", 10, 1000.0, 2, 5.0)] + [(k, "r", 11, 1000.0 * (1 - 9e-6), 2, 5.0 + k) for k in range(1, 7)] + [(7, "r", 13, 1000.0 * (1 + 9e-6), 2, 5.0), (8, "r", 50, 900.0, 2, 1.0), (9, "r", 50, 900.0, 2, 1.0)]
    got = {r["k"]: r["feature"] for r in features.peak_clusters(spark.createDataFrame(rows, PEAK)).collect()}
    assert len(got) == 10 and len({got[k] for k in range(8)}) == 1 and got[8] == got[9] != got[0]


def test_clusters_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice("ab"), rng.randint(1, 60), rng.choice([500.0, 1000.0]) * (1 + rng.uniform(-40, 40) * 1e-6), rng.randint(1, 3), 1.0) for k in range(160)]
    got = {r["k"]: r["feature"] for r in features.peak_clusters(spark.createDataFrame(rows, PEAK), ppm=7.0, gap=3).collect()}

    def linked(i, j):
        a, b = rows[i], rows[j]
        return a[1] == b[1] and 0 <= b[2] - a[2] <= 3 and abs(a[3] - b[3]) <= a[3] * 7e-6

    assert partition([got[k] for k in range(160)]) == partition(components_of(160, linked))


def test_merging_and_alignment_links_against_all_pairs(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), k, 1000.0 * (1 + rng.uniform(-60, 60) * 1e-6), rng.randint(0, 40) / 400, 1.0) for k in range(150)]
    df = spark.createDataFrame(rows, "run string, feature long, mass double, net double, abundance double")
    near = lambda a, b: abs(a[2] - b[2]) <= a[2] * 8e-6 and abs(a[3] - b[3]) <= 0.01
    merged = {r["feature"]: r["component"] for r in features.merged_features(df, ppm=8.0, net=0.01).collect()}
    assert [merged[k] for k in range(150)] == components_of(150, lambda i, j: rows[i][0] == rows[j][0] and near(rows[i], rows[j]))
    groups = {r["feature"]: r for r in features.aligned(df, 8.0, 0.01).collect()}
    whole = components_of(150, lambda i, j: rows[i][0] != rows[j][0] and near(rows[i], rows[j]))
    assert len(groups) == 150
    for c in set(whole):
        # the rule of groups, row by row
        left, want = sorted((k for k in range(150) if whole[k] == c), key=lambda k: (rows[k][3], k)), {}
        while left:
            best = None
            for i in left:
                nearest = {}
                for j in left:
                    gap = abs(rows[j][3] - rows[i][3])
                    if rows[j][0] != rows[i][0] and gap <= 0.01 and (rows[j][0] not in nearest or gap < nearest[rows[j][0]][0]):
                        nearest[rows[j][0]] = (gap, j)
                cost = (-len(nearest), sum(g for g, _ in nearest.values()), i)
                if best is None or cost < best[0]:
                    best = (cost, i, [j for _, j in nearest.values()])
            for j in (best[1], *best[2]):
                want[j] = best[1]
                left.remove(j)
        assert {k: groups[k]["group_id"] for k in want} == want


def test_overlapping_features_go_by_abundance(spark):
    rng = random.Random(4)
    rows = [("r", k, 1000.0 * (1 + rng.choice([0, 4, 300]) * 1e-6), s := rng.randint(1, 300), s + rng.randint(0, 120), float(rng.randint(1, 40))) for k in range(120)]
    df = spark.createDataFrame(rows, "run string, feature long, mass double, min_scan int, max_scan int, abundance double")
    got = {r["feature"] for r in features.without_overlaps(df, 10.0).collect()}
    taken = []
    for row in sorted(rows, key=lambda r: (-r[5], r[1])):
        if not any(abs(row[2] - o[2]) < 0.05 and row[3] <= o[4] and o[3] <= row[4] for o in taken):
            taken.append(row)
    assert got == {r[1] for r in taken}


def test_scores_of_any_size_are_kept():
    nodes = np.zeros(11, int)
    nodes[[2, 4]] = [2500, -1800]
    low, p = scoring.score_distribution(nodes, np.array([2, 3]), np.array([0.5, 0.5]), 10)
    assert p.sum() > 0 and scoring.tail_probability(low, p, 2500) == pytest.approx(p[2500 - low :].sum() / p.sum())
    assert scoring.tail_probability(low, p, 9999) == 1e-300
    assert scoring.tail_probability(*scoring.score_distribution(nodes, np.array([4]), np.array([1.0]), 10), 1) == 1.0


def test_rates_of_many_equal_scores(spark):
    """Ties are divided among the ranges too and still go by the order that is given."""
    rng = random.Random(2)
    rows = [(k, rng.choice([0.0, 0.0, 0.0, 1.0, None]), rng.random() < 0.3) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, score double, decoy boolean")
    got = {r["k"]: (r["fdr"], r["q_value"]) for r in windows.running_fdr(df, "score", "decoy", [F.col("k")], 13).collect()}
    decoys = targets = 0
    fdr = []
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    for _, _, decoy in ordered:
        decoys, targets = decoys + decoy, targets + (not decoy)
        fdr.append(min(1.0, decoys / targets) if targets else 1.0)
    least = 1.0
    for (k, _, _), f in zip(reversed(ordered), reversed(fdr), strict=True):
        least = min(least, f)
        assert got[k] == (pytest.approx(f), pytest.approx(least))
