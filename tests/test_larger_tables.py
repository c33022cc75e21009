"""Cases that only larger tables bring up: long chains, constant chromatograms, estimates that are too low."""

import random

import duckdb
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from spectroloom import plans
from spectroloom.operators import chromatograms, evidence, graph, joins, tags


def test_constant_chromatograms(spark):
    # points that all are equal have no correlation; corr() fails on them in ANSI mode
    a = spark.createDataFrame([(1, s, 5.0) for s in range(3)] + [(2, s, float(s)) for s in range(3)], "k int, scan int, v double")
    b = spark.createDataFrame([(k, s, float(s)) for k in (1, 2) for s in range(3)], "k int, scan int, v double")
    got = {r["k"]: (r["n"], round(r["correlation"], 9)) for r in chromatograms.xic_correlation(a, b, ["k"], "scan", "v").collect()}
    assert got == {1: (3, 0.0), 2: (3, 1.0)}


def test_charge_score_of_constant_points(spark):
    rows = [("c", s, z, 5.0) for s in range(3) for z in (1, 2)] + [("u", s, z, float(s)) for s in range(3) for z in (1, 2)]
    points = spark.createDataFrame(rows, "k string, scan_num int, charge int, intensity double")
    got = {r["k"]: (round(r["charge_correlation"], 9), r["pairs"]) for r in evidence.xic_charge_score(points, ["k"]).collect()}
    assert got == {"c": (0.0, 1), "u": (1.0, 1)}


def test_components_of_long_chains(spark):
    # least labels alone travel a link a round between far ends
    ids = random.Random(1).sample(range(100_000), 4000)
    chains = [ids[:3000], ids[3000:]]
    links = [(a, b) for c in chains for a, b in zip(c, c[1:], strict=False)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    got = graph.connected_components(nodes, spark.createDataFrame(links, "u long, v long"), rounds=20, one_task=0).collect()
    assert {r["id"]: r["component"] for r in got} == {i: min(c) for c in chains for i in c}


def test_components_store_no_circles(spark, monkeypatch):
    stored = []
    kept = graph.materialised
    monkeypatch.setattr(graph, "materialised", lambda df: stored.append(kept(df)) or stored[-1])
    links = spark.range(300).selectExpr("id AS u").join(spark.range(300).selectExpr("id AS v")).coalesce(2)
    got = graph.connected_components(spark.range(300), links, one_task=0).collect()
    assert {r["component"] for r in got} == {0}
    assert stored[0].count() < 2 * 300


def test_links_of_a_band(spark):
    deal = random.Random(2)
    rows = [(i, i % 2, round(deal.uniform(0, 400) ** 1.2, 1)) for i in range(300)] + [(300 + i, 0, 600.0 + 3 * i) for i in range(9)] + [(400, 1, None)]
    df = spark.createDataFrame(rows, "id long, k int, x double")
    links = joins.band_links(df, "id", "x", 3.0, ["k"])
    assert links.count() < 2 * len(rows)
    got = {r["id"]: r["component"] for r in graph.connected_components(df, links).collect()}
    want = {i: i for i, _, _ in rows}
    for k in (0, 1):
        line = sorted((x, i) for i, j, x in rows if j == k and x is not None)
        group: list = []
        for n, (x, i) in enumerate(line):
            group = [*group, i] if n and x - line[n - 1][0] <= 3.0 else [i]
            want |= dict.fromkeys(group, min(group))
    assert got == want


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_copied_rows_are_not_broadcast(spark):
    # a plan goes by the size of the file, which copies and pieces exceed by far
    texts = spark.createDataFrame([(i, "large ring") for i in range(50)], "id long, text string")
    pieces = joins.substring_join(texts, spark.createDataFrame([("ring",)], "pattern string"), "text", "pattern", 3, ["id"])
    assert pieces.count() == 50
    peaks = spark.createDataFrame([(1, 100.0, 1), (1, 157.02146, 2)], "k int, mass double, node int")
    edges = tags.tag_edges(peaks, ["k"], "mass", "node", 20.0)
    assert [(r["from_node"], r["to_node"], r["residue"]) for r in edges.collect()] == [(1, 2, "G")]
    for df in (pieces, edges):
        assert "BroadcastHashJoin" not in _plan(df) and "SortMergeJoin" in _plan(df)


@pytest.mark.parametrize("name, expected", [("aligned_runs", 3), ("alignment_crosstab", 1), ("overlapping_features_removed", 1)])
def test_made_features_stay_apart(spark, tmp_path, name, expected):
    # far down a large table neighbours lie within the tolerance of each other's masses
    near = spark.read.parquet(f"{DATA}/sf0.001/customer.parquet").withColumn("c_custkey", F.col("c_custkey") + 900_000)
    near.write.parquet(f"{tmp_path}/customer.parquet")
    assert near.count() == 150
    got = plans.queries()[name](spark, str(tmp_path))
    assert got.count() == 150 * expected
    if name == "aligned_runs":
        assert got.where("group_mass <> feature * 10 + 1000").count() == 0


def test_components_are_whole_across_batches(spark):
    # components larger than a batch beside many small ones, each gone through once
    rows = [(i, i % 7 if i < 70 else i, float(i % 5), 10 * i, 10 * i + (15 if i < 70 else 5)) for i in range(170)]
    df = spark.createDataFrame(rows, "id long, component long, score double, low long, high long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        sizes = graph.per_component(df, "component", lambda g: g.groupby("component", as_index=False).size(), "component long, size long").collect()
        taken = graph.greedy_non_overlapping(df, "component", "score", "low", "high", "id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in sizes) == sorted([(c, 10) for c in range(7)] + [(i, 1) for i in range(70, 170)])
    assert len(taken) == 170


@pytest.mark.parametrize("name", ["nearest_deconvoluted_mass", "features_with_matches"])
def test_differences_are_rounded_as_in_sql(spark, tmp_path, name):
    # peaks as near on either side, and at the very edge: (mass + 2000) - (other + 2000) is rounded otherwise than the SQL's
    suppliers, customers = [], []
    for i in range(1500):
        x = round(-900 + i * 7.13, 2)
        suppliers.append((i, i % 15, x))
        edge = round((x + 2000) * 2000 / 1e6, 2)
        customers += [(8 * i + n, "n%06d" % (8 * i + n), i % 15 + n % 8 if name == "features_with_matches" else i % 15, round(x + d, 2)) for n, d in enumerate((-0.03, 0.03, -edge, edge))]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for table in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    same_rows(plans.queries()[name](spark, str(tmp_path)), con.execute(plans.oracle_sql()[name]))
