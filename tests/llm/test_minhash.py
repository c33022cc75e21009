"""MinHash near-duplicates against comparing the sets of all pairs."""

import random

import numpy as np
import pytest
from conftest import DATA, duck, same_rows

from spectroloom.llm import minhash, queries


def slow(rows, percent=80, shingle=4):
    """{id: (set size, least id reachable)} of (id, text)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in sets if sets[i]]
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, **more).collect()}


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def family():
    """Copies of copies at all distances around the threshold, and strangers."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    kept = [base]
    for _ in range(90):
        kept.append(edited(rng, rng.choice(kept[-12:]), rng.choice([0.0, 0.01, 0.02, 0.03, 0.05])))
    kept += [[f"v{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 4, 9, 60]))] for _ in range(30)]
    return [(i, " ".join(w)) for i, w in enumerate(kept)]


def test_query_against_sql(spark):
    same_rows(queries.op13_minhash(spark, f"{DATA}/sf0.01"), duck("sf0.01").execute(queries.OP13_SQL))


def test_chains_and_near_misses(spark, family):
    df = spark.createDataFrame(family, "doc_id long, text string")
    assert result(df) == slow(family)


def test_blocks_and_piles_of_any_size(spark, family, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "ROWS", 7)
    monkeypatch.setattr(minhash, "SHINGLES", 900)
    df = spark.createDataFrame(family, "doc_id long, text string")
    assert result(df) == slow(family)


def test_lists_of_rarest_shingles_may_be_cut(spark, family, monkeypatch):
    monkeypatch.setattr(minhash, "RAREST", 9)
    df = spark.createDataFrame(family, "doc_id long, text string")
    assert result(df) == slow(family)


def test_near_misses_of_a_large_group_are_not_told_pair_by_pair(spark, monkeypatch):
    """Every one of 60 looks like every one of 120, and is linked with none of them."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(160)]

    def spoilt(n):
        at = set(rng.sample(range(5, 150, 5), n))
        return " ".join(w + f"x{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(base))

    rows = list(enumerate([" ".join(base), *(spoilt(2) for _ in range(120)), *(spoilt(5) for _ in range(60))]))
    told, confirmed = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda texts, pairs, *more: told.append(pairs.count()) or confirmed(texts, pairs, *more))
    want = slow(rows)
    assert len({c for _, c in want.values()}) == 61
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert sum(told) < 3 * len(rows)


def test_bounds_of_common_shingles_hold():
    rng, most = np.random.default_rng(5), 12
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(80)]
    codes = [x[:most] for x in sets]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in codes])])
    u, v = (x.ravel() for x in np.mgrid[:80, :80])
    got = minhash.in_common(np.concatenate(codes), bounds, np.array([len(x) for x in sets]), u, v)
    exact = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(u, v, strict=True)])
    whole = np.array([len(sets[i]) <= most and len(sets[j]) <= most for i, j in zip(u, v, strict=True)])
    assert (got >= exact).all() and (got[whole] == exact[whole]).all()
    assert (got[~whole] < np.minimum(*(np.array([len(sets[i]) for i in x]) for x in (u, v)))[~whole]).any()


def test_odd_rows(spark):
    text = "One two  three\nfour five"
    rows = [(5, None), (6, ""), (7, " \t"), (3, text), (3, text), (4, text.upper()), (None, text.lower()), (None, "alone here"), (9, "few words"), (8, "FEW words"), (10, "long " * 150_000), (11, "long " * 160_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id long, body string, cls int, key string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, doc_id="id", text="body").collect()), key=str)
    want = [(5, 0, 5), (6, 0, 6), (7, 0, 7), (3, 2, 3), (3, 2, 3), (4, 2, 3), (None, 2, 3), (None, 1, None), (9, 1, 8), (8, 1, 8), (10, 1, 10), (11, 1, 10)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(df.limit(0), doc_id="id", text="body").count() == 0


def test_estimates_follow_similarity():
    rng, k = np.random.default_rng(2), 512
    functions = minhash.hash_functions(k)
    for share in (0.2, 0.5, 0.8, 0.95):
        pool = rng.integers(0, 1 << 64, 3000, np.uint64)
        both = int(3000 * share)
        rest = (3000 - both) // 2
        a, b = pool[: both + rest], np.concatenate([pool[:both], pool[both + rest :]])
        x, y = (minhash.packed_bits(minhash.minima(s, functions))[None] for s in (a, b))
        same = int(minhash.agreements(x, y, k)[0, 0])
        assert abs(minhash.estimate(same, k) - share) < 0.1
    assert minhash.least_agreement(0.8, k) < k * 0.8125
