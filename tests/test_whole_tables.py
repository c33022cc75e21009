"""Queries without SQL process whole tables: small fixtures whose ids lie beyond every former bound."""

import numpy as np

from spectroloom import plans
from spectroloom.functions.mass import NOMINAL_SCALE, RESIDUE_MASS, RESIDUES
from spectroloom.operators import scoring


def test_generating_function_takes_every_part(spark, tmp_path):
    spark.createDataFrame([(k, k % 7 + 1) for k in (1, 199, 200, 5000, 10**7)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: r["spec_e_value"] for r in plans.queries()["generating_function_e_values"](spark, str(tmp_path)).collect()}
    steps = np.array([int(round(RESIDUE_MASS[r] * 0.9995)) for r in RESIDUES])
    want = {}
    for k in (1, 199, 200, 5000, 10**7):
        size = k % 7 + 1
        target = size * 20 + 300
        scores = np.zeros(target + 1, int)
        scores[[m for m in range(57, 57 * 13, 57) if m < target]] = 1
        want[k] = scoring.tail_probability(*scoring.score_distribution(scores, steps, np.full(len(steps), 1 / len(steps)), target), size % 5 + 1)
    assert got == want


def test_quick_counts_take_every_part_and_order(spark, tmp_path):
    names = {1: "zz yy", 299: "red blue", 300: "green lime", 9000: "red blue", 10**7: "navy pink plum"}
    spark.createDataFrame(list(names.items()), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    prefixes = {k: {round(sum(RESIDUE_MASS.get(r, 0.0) for r in s[:i]) * NOMINAL_SCALE) for i in range(1, len(s))} for k, s in ((k, n.upper().replace(" ", "")) for k, n in names.items())}
    rows = [(o, 100.0 * sum(RESIDUE_MASS.get(r, 0.0) for r in s)) for o, n in ((5, "red blue"), (1999, "green lime"), (2000, "navy pink plum"), (10**8, "green lime")) for s in [n.upper().replace(" ", "")[:i] for i in range(1, 5)]]
    spark.createDataFrame(rows, "l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r["l_orderkey"], r["p_partkey"], r["n_bins"]) for r in plans.queries()["quick_counts"](spark, str(tmp_path)).collect())
    want = []
    for order in (5, 1999, 2000, 10**8):
        bins = {round(p / 100 * NOMINAL_SCALE) for o, p in rows if o == order}
        n, part = min((-len(bins & b), k) for k, b in prefixes.items())
        want.append((order, part, -n))
    assert got == sorted(want)


def test_greedy_selection_of_every_customer(spark):
    from conftest import DATA

    rows = spark.read.parquet(f"{DATA}/sf0.001/customer.parquet").collect()
    want = set()
    for nation in {r["c_nationkey"] for r in rows}:
        taken = []
        for r in sorted((r for r in rows if r["c_nationkey"] == nation), key=lambda r: (-r["c_acctbal"], r["c_custkey"])):
            low = r["c_custkey"] % 200
            if all(low + 20 < x or x + 20 < low for x in taken):
                taken.append(low)
                want.add((r["c_custkey"], nation))
    assert {tuple(r) for r in plans.queries()["greedy_non_overlapping"](spark, f"{DATA}/sf0.001").collect()} == want


def test_averagine_envelopes_of_every_part(spark):
    """Isotopes of the average atoms as a plain convolution of each atom's own isotopes."""
    import math

    from conftest import DATA

    from spectroloom.functions.mass import ATOM_MASS
    from spectroloom.functions.numeric import ABUNDANCE

    unit = {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}
    known = {}

    def envelope(nominal):
        mass = nominal / 0.9995
        counts = {a: int(round(mass / sum(k * ATOM_MASS[a] for a, k in unit.items()) * n)) for a, n in unit.items()}
        means = [sum(n * ABUNDANCE[a][d] for a, n in counts.items()) for d in (1, 2, 3)]
        poisson = lambda m, k: math.exp(k * math.log(m) - m - math.lgamma(k + 1)) if m > 0 else float(k == 0)
        out = [sum(poisson(means[0], i - 2 * j - 3 * k) * poisson(means[1], j) * poisson(means[2], k) for k in range(i // 3 + 1) for j in range((i - 3 * k) // 2 + 1)) for i in range(40)]
        top = max(range(40), key=lambda i: out[i])
        return next(i for i in range(top, 40) if out[i] < 0.1 * out[top]), top

    prices = {r["p_partkey"]: r["p_retailprice"] for r in spark.read.parquet(f"{DATA}/sf0.001/part.parquet").collect()}
    got = plans.queries()["averagine_envelopes"](spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(prices)
    for r in got:
        nominal = int(round(prices[r["p_partkey"]] * 10 * 0.9995))
        if nominal not in known:
            known[nominal] = envelope(nominal)
        assert (r["n"], r["most_abundant"]) == known[nominal]


def test_rank_sums_of_every_part(spark):
    from statistics import NormalDist

    from conftest import DATA

    sizes = {r["p_partkey"]: r["p_size"] for r in spark.read.parquet(f"{DATA}/sf0.001/part.parquet").collect()}
    got = plans.queries()["significance_tests"](spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(sizes)
    for r in got:
        u = 20 * 180 + 20 * 21 / 2 - sizes[r["p_partkey"]] * 60
        assert abs(r["rank_sum"] - abs(1 - NormalDist(20 * 180 / 2, (20 * 180 * 201 / 12) ** 0.5).cdf(u))) < 1e-8
