import random
import time

import numpy as np
import pytest
import xxhash
from conftest import DATA, duck, same_rows
from pyspark.sql import functions as F

from spectroloom.llm import queries, simhash, substrings


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(rows, most=3):
    """Least id reachable, by all pairs of distinct fingerprints."""
    fps = sorted({fp for _, fp in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= most:
                parent[find(a)] = find(b)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return {(i, fp): least.get(find(fp)) for i, fp in rows}


def test_simhash_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs]
    want = classes(rows)
    got = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in queries.op5_simhash(spark, f"{DATA}/sf0.01").collect()}
    assert got == want
    assert all(len(r["fingerprint"]) == 16 for r in queries.op5_simhash(spark, f"{DATA}/sf0.001").collect())


def test_links_of_dense_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set()
    for b in base:
        x = b
        for _ in range(60):  # chains of near values, and values 3 and 4 bits away
            x ^= 1 << rng.randrange(64)
            fps |= {x, x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in rows], "fp long")
    from spectroloom.llm.graph import components

    nodes = {r["node"] % (1 << 64): r["root"] for r in components(simhash.links(df)).collect()}
    want = classes(rows)
    groups = {}
    for i, f in rows:
        groups.setdefault(want[i, f], set()).add(nodes.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_divided_groups_have_the_same_links(monkeypatch):
    rng = random.Random(6)
    x = rng.getrandbits(64)
    members = set()
    for _ in range(400):
        x ^= 1 << rng.randrange(64)
        members.add(x)
    members = np.array(sorted(members), np.uint64)

    def parts(u, v):
        parent = {int(m): int(m) for m in members}

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            parent[find(a)] = find(b)
        return {frozenset(m for m in parent if find(m) == r) for r in {find(m) for m in parent}}

    whole = parts(*simhash.forest(members, 3))
    assert parts(*simhash.links_within(members, 3)) == whole
    monkeypatch.setattr(simhash, "TOGETHER", 10)
    assert parts(*simhash.links_within(members, 3)) == whole


def test_many_members_of_one_segment():
    rng = np.random.default_rng(8)
    values = np.unique(rng.integers(0, 1 << 32, 100_000, np.uint64))
    values[1000:2000] = values[:1000] ^ np.uint64(1 << 20)
    members = np.unique(np.uint64(77 << 32) | values)
    began = time.perf_counter()
    u, v = simhash.links_within(members, 3, np.arange(32))
    assert time.perf_counter() - began < 6 and len(u) >= 900
    few = rng.choice(members[:3000], 2500, replace=False)
    name = lambda pairs: {frozenset(p) for p in zip(*(x.tolist() for x in pairs), strict=True)}
    got, want = simhash.links_within(few, 3, np.arange(32)), simhash.forest(few, 3)
    assert name(want) <= name(got) or components_of(few, got) == components_of(few, want)


def components_of(members, pairs):
    root = {int(m): int(m) for m in members}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*(x.tolist() for x in pairs), strict=True):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {m: find(m) for m in root}


def test_simhash_odd_rows(spark):
    rows = [(5, None), (3, ""), (None, "one two"), (9, "one two"), (9, "one two"), (1, "x " * 200_000), (2, "Same text here now"), (4, "same TEXT here now"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1)).withColumn("component_id", F.lit(2))
    got = simhash.near_duplicates(df).select("doc_id", "fp", "component_id").collect()
    want = classes([(i, slow_fingerprint(t)) for i, t in rows])
    assert sorted(map(str, [(r["doc_id"], r["component_id"]) for r in got])) == sorted(map(str, [(i, want[i, slow_fingerprint(t)]) for i, t in rows]))
    kept = simhash.representatives(df).collect()
    assert len(kept) == len({want[i, slow_fingerprint(t)] for i, t in rows}) and all(r["fp"] == "clash" for r in kept)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, "a b c d"), (None, "q r s t")], "doc_id long, text string")
    assert simhash.representatives(nothing).count() == 2


def naive_removed(docs, least):
    first = {}
    for i, words in docs:
        for k in range(len(words) - least + 1):
            w = tuple(words[k : k + least])
            first[w] = min(i, first.get(w, i))
    out = []
    for i, words in docs:
        gone = set()
        for k in range(len(words) - least + 1):
            if first[tuple(words[k : k + least])] < i:
                gone |= set(range(k, k + least))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdefgh"
    pool = [[rng.choice(letters) for _ in range(30)] for _ in range(6)]
    docs = []
    for i in rng.sample(range(1000), 80):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(pool)[rng.randint(0, 5) : rng.randint(10, 30)] if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randint(1, 20))]
        docs.append((i, words))
    want = naive_removed(docs, 10)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    for hot in (4096, 2):
        monkeypatch.setattr(substrings, "HOT", hot)
        got = substrings.without_repeats(df, 10).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"], " ".join(r["text"].split())) for r in got) == sorted(want)


def test_automaton():
    rng = random.Random(2)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 12))] for _ in range(8)]
    a = substrings.SuffixAutomaton(texts)
    known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(50):
        q = [rng.choice("abc") for _ in range(15)]
        want = [max((n for n in range(e + 1) if tuple(q[e - n : e]) in known or not n), default=0) for e in range(1, len(q) + 1)]
        assert a.statistics(q) == want


def test_repeats_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "x  " + long + "\n tail"), (5, "\t" + " ".join(f"v{k}" for k in range(100_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("bucket", F.lit(1)).withColumn("extra", F.lit(2))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"], r["extra"], r["bucket"]) for r in substrings.without_repeats(df).where("doc_id is null or doc_id > 2").collect())
    assert ("4", 62, 60, "x  tail", 2, 1) in got
    assert [g[:3] for g in got if g[0] in ("3", "None")] == [("3", 60, 0), ("3", 60, 0), ("None", 60, 0)]
    assert {r["doc_id"]: r["text"] for r in substrings.without_repeats(df).where("doc_id <= 2").collect()} == {1: None, 2: ""}
    assert substrings.without_repeats(df.limit(0)).count() == 0


def test_substrings_query_against_sql(spark):
    same_rows(queries.op8_substrings(spark, f"{DATA}/sf0.01"), duck("sf0.01").execute(queries.OP8_SQL))


def test_any_column_name_and_any_id(spark):
    names = ("_id", "_print", "_row", "_i", "_p", "_r", "_bucket", "_number", "_of", "_n", "bucket", "id", "doc")
    long = " ".join(f"w{k}" for k in range(60))
    rows = [("b10", "same text here now"), ("b9", "same text here now"), (None, "same text here now"), ("a", "x " + long), ("b", long + " y"), ("b", long + " y"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("which", F.monotonically_increasing_id())
    for n in names:
        df = df.withColumn(n, F.lit(f"mine {n}"))
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    # the two rows with long texts are no near duplicates; one of each other group stays, the least id's
    assert sorted(r["doc_id"] for r in kept.collect()) == ["a", "b", "b10", "c"]
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect() if r["doc_id"] != "a"} >= {("b9", "b10"), ("b10", "b10"), (None, "b10"), ("c", "c")}
    done = substrings.without_repeats(df)
    assert done.columns == [*df.columns, "n_words", "n_removed", "kept_sha256"]
    got = sorted((str(r["doc_id"]), r["n_removed"], r["text"], r["_bucket"]) for r in done.collect())
    assert got == sorted((str(i), 60 if i == "b" else 0, "y" if i == "b" else t, "mine _bucket") for i, t in rows)


def test_survivor_of_repeated_rows_is_the_same_in_every_run(spark):
    rows = [(1, "one two three", f"src{k}") for k in range(40)]
    got = [simhash.representatives(spark.createDataFrame(r, "doc_id long, text string, source string")).collect() for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 1


def test_windows_of_equal_first_hash_stay_apart():
    a, b, which = substrings._distinct(np.array([5, 3, 5, 5], np.uint64), np.array([1, 9, 2, 1], np.uint64))
    assert a.tolist() == [3, 5, 5] and b.tolist() == [9, 1, 2] and which.tolist() == [1, 0, 2, 1]
