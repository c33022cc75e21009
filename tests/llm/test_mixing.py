import itertools
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from spectroloom.llm import mixing, queries


def test_water_fill():
    assert mixing.water_fill([100, 100], [1, 1], 100, 2) == [50, 50]
    assert mixing.water_fill([10, 1000], [5, 1], 300, 2) == [20.0, 280.0]
    assert mixing.water_fill([0, 10], [1, 1], 5, 2) == [0.0, 5.0]
    got = mixing.water_fill([1, 2, 3], [5, 2, 1], 9, 2)
    assert sum(got) == pytest.approx(9) and all(g <= 2 * s for g, s in zip(got, [1, 2, 3], strict=True))


def test_fit_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(60):
        lengths = sorted({rng.randint(0, 12) for _ in range(4)})
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 40)
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        got = sum(t * z for t, z in zip(take, lengths, strict=True))
        best = max(s for s in (sum(a * z for a, z in zip(x, lengths, strict=True)) for x in itertools.product(*[range(c + 1) for c in counts])) if s <= budget)
        assert got == best


def test_fit_of_large_budgets():
    lengths = list(range(1, 3000, 7))
    counts = [40] * len(lengths)
    total = sum(z * 40 for z in lengths)
    for share in (0.1, 0.5, 0.93):
        take = mixing.fit(lengths, counts, int(total * share))
        assert 0 <= int(total * share) - sum(t * z for t, z in zip(take, lengths, strict=True)) <= 1


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_query(spark):
    sf = f"{DATA}/sf0.01"
    got = rows_of(queries.op2_mixing(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sizes = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    source = {}
    for r in docs:
        source[r["source"]] = source.get(r["source"], 0) + sizes[r["doc_id"]]
    names = sorted(source, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, mixing.water_fill([source[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(source.values()), 2), strict=True))
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r["source_size"] == source[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(str, rows_of(queries.op2_mixing(spark, sf)))) == sorted(map(str, got))


def test_nulls_ties_and_clashes(spark):
    rows = [(i % 5 if i % 7 else None, "a b c" if i % 3 else None, "s" if i % 2 else None, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").withColumn("taken", F.lit(1)).withColumn("n", F.lit(7))
    got = rows_of(mixing.mix(df))
    assert len(got) == 60 and all(r["n"] == 7 for r in got)
    for s in ("s", None):
        own = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3
    assert mixing.mix(df.limit(0)).count() == 0


def test_one_very_common_length(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("s").alias("source"))
    got = rows_of(mixing.mix(df, budget_share=0.4))
    assert sum(r["taken"] for r in got) == 4800


def test_fit_tries_every_length():
    # long even lengths come first and more than 4096 of them; only the one odd length makes the odd sum
    lengths = [7, *range(10_000, 22_000, 2)]
    counts = [1] * len(lengths)
    budget = 55_007
    take = mixing.fit(lengths, counts, budget)
    assert all(0 <= t <= 1 for t in take) and sum(t * z for t, z in zip(take, lengths, strict=True)) == budget


def test_fit_of_very_long_documents():
    rng = random.Random(9)
    for _ in range(200):
        dp = rng.choice([16, 17, 64])
        lengths = sorted({rng.randint(1, 150) for _ in range(5)})
        counts = [rng.randint(1, 2) for _ in lengths]
        budget = rng.randint(1, 500)
        take = mixing.fit(lengths, counts, budget, dp)
        got = sum(t * z for t, z in zip(take, lengths, strict=True))
        assert got <= budget and all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert all(t == c or z > budget - got for t, c, z in zip(take, counts, lengths, strict=True))


def test_fit_is_exact_for_documents_longer_than_the_programme():
    take = mixing.fit([70_000, 100_001, 130_003], [3, 3, 3], 210_000)
    assert take == [3, 0, 0]


def test_internal_names_repeated_rows_and_both_joins(spark, monkeypatch):
    names = ("row", "id", "order", "bucket", "of", "words", "cut", "key", "from_key", "at_key", "quota", "n", "repeats", "extra", "rank", "_mix_n", "source_size", "target")
    rows = [(7 if i % 2 else i, "a b c" if i % 3 else "a b", "s", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mine int")
    for n in names:
        df = df.withColumn(n, F.lit(f"mine {n}"))
    seen = []
    for bound in (mixing.BROADCAST_ROWS, -1):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", bound)
        got = rows_of(mixing.mix(df, budget_share=0.37))
        assert sorted(r["mine"] for r in got) == list(range(400)) and all(r[n] == f"mine {n}" for r in got for n in names[:-2])
        assert sum(r["taken"] for r in got) == round(got[0]["target"]) and all(r["taken"] in (0, r["size"]) for r in got)
        seen.append(sorted((r["mine"], r["taken"]) for r in got))
    assert seen[0] == seen[1]
    text_ids = df.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "source")
    assert sum(r["taken"] for r in rows_of(mixing.mix(text_ids, budget_share=0.37))) == sum(t for _, t in seen[0])


def test_targets_of_a_table_are_those_of_a_list(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 60):
        rows = [(f"s{k:02}" if k else None, rng.choice([0, 1, 5, 50, 1000, 20_000])) for k in range(n)]
        got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.shared(spark.createDataFrame(rows, "source string, words long"), (5, 2, 1), 1.5, 2).collect()}
        names = sorted((s for s, _ in rows), key=lambda s: (s is None, s or ""))
        sizes = [dict(rows)[s] for s in names]
        want = mixing.water_fill(sizes, [(5, 2, 1)[k % 3] for k in range(n)], 1.5 * sum(sizes), 2)
        assert [got[s] for s in names] == [(z, pytest.approx(t)) for z, t in zip(sizes, want, strict=True)]
    assert mixing.shared(spark.createDataFrame([], "source string, words long"), (5, 2, 1), 1.5, 2).count() == 0
