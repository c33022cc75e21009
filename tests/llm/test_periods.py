"""Periodic runs against comparing a text with itself at every distance."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA

from spectroloom.llm import common, periods, queries


def slow_runs(words):
    known = {}
    x = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    runs = {}
    for q in range(1, len(x) // 3 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], x[:-q] == x[q:], [False]]).astype(int)))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j - i + q >= max(24, 3 * q):
                runs.setdefault((i, j + q), q)
    return sorted((s, e - s, p) for (s, e), p in runs.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = slow_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


def found(words):
    numbers, bounds, _ = common.encoded([common.spaced(" ".join(words).encode())])
    return periods.runs_of(numbers, bounds, 24, 3)[0]


def test_query_against_every_distance(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periods(spark, f"{DATA}/sf0.01").collect()}
    assert got == {i: expected(i, t) for i, t in rows}
    assert sum(g[0] for g in got.values()) > 100


def test_nested_and_touching_runs():
    rng = random.Random(3)
    for _ in range(150):
        n, k = rng.choice([0, 1, 5, 24, 30, 60, 200, 500]), rng.choice([1, 2, 3, 50])
        x = [str(rng.randrange(k)) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 30:
                a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // rng.choice([3, 4, 10, 50])))
                for i in range(a, rng.randrange(a, n + 1)):
                    x[i] = x[a + (i - a) % p]
        assert found(x) == slow_runs(x)


@pytest.mark.parametrize(("n", "period"), [(3000, 900), (30000, 9001), (120000, 39999)])
def test_long_periods_by_each_kind_of_transform(n, period):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 70000, n)
    x[1:] = x[1 + np.arange(n - 1) % period]
    assert (1, n - 1, period) in found([str(w) for w in x])


def test_transforms_are_exact():
    for size in (16, 512, 1024, 1 << 17):
        t = periods.Transform(size)
        rng = np.random.default_rng(size)
        blocks = rng.integers(0, t.prime, (2, size // 2)).astype(float if t.short else np.int64)
        there = t.forward(blocks)
        assert (t.backward(there.copy()).astype(np.int64) % t.prime == blocks.astype(np.int64)).all()
        # a block against the two that follow it, at one distance
        window, d = np.concatenate([blocks[1], np.zeros(size // 2)]).astype(object), size // 8
        meets = t.backward(there[:1][:, t.negative] * there[1:])[0, d]
        assert int(meets) % t.prime == sum(int(a) * int(b) for a, b in zip(blocks[0], window[d:], strict=False)) % t.prime


def test_odd_rows(spark):
    line = "buy it now " * 20
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, line), (None, line), (4, "w " * 200_000), (5, "one two three")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, body string, runs string")
    got = periods.with_runs(df, "body").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    assert by[1] == by[2] == by[3] == [([], "")]
    assert by[None] == [([(0, 60, 3)], "buy it now")] * 2
    assert by[4] == [([(0, 200_000, 1)], "w")] and by[5] == [([], "one two three")]
    assert periods.with_runs(df.limit(0), "body").count() == 0
    with pytest.raises(ValueError, match="24 words"):
        periods.with_runs(df, "body", least=5)
