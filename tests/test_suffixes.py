"""Suffix orders against sorted lists of strings."""

import random

import pytest

from spectroloom.operators.suffixes import distinct_substrings, suffix_array


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _brute(rows):
    every = sorted((s[i:], p is not None, p or 0, i + 1) for p, s in rows if s for i in range(len(s)))
    out, before = [], ""
    for position, (suffix, known, p, start) in enumerate(every, 1):
        out.append((p if known else None, start, len(suffix), position, _common(suffix, before)))
        before = suffix
    return out


def _counts(rows):
    found = {s[a:b] for _, s in rows if s for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    lengths = [len(f) for f in found]
    return {n: lengths.count(n) for n in set(lengths)}


CASES = {
    "repeats": [(1, "ABABABABABABAB"), (2, "BABABA"), (3, "A"), (4, ""), (5, None), (6, "AAAAAAAAAAAAAAAAAAAAA")],
    "equal sequences and ids": [(7, "MKVLMKVL"), (7, "MKVLMKVL"), (None, "MKV"), (8, "LVKM")],
    "none": [(1, ""), (2, None)],
    "random": [(k, "".join(random.Random(k).choices("AB", k=random.Random(-k).randint(0, 40)))) for k in range(12)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("head", [2, 16])
def test_suffix_array(spark, case, head):
    rows = CASES[case]
    table = spark.createDataFrame([(p, s, "x", 1) for p, s in rows], "p long, s string, head string, rank int")
    order = suffix_array(table, "p", "s", head)
    assert order.columns == ["p", "start", "length", "position", "common"]
    assert sorted((tuple(r) for r in order.collect()), key=lambda r: r[3]) == _brute(rows)
    assert {r.length: r.substrings for r in distinct_substrings(order).collect()} == _counts(rows)


def test_suffixes_of_a_long_sequence(spark):
    # the second half repeats the first, so that suffixes share up to 3,000 residues
    half = "".join(random.Random(5).choices("ACDEFGHIKLMNPQRSTVWY", k=3000))
    order = suffix_array(spark.createDataFrame([(1, half + half)], "p long, s string"), "p", "s").collect()
    assert sorted((tuple(r) for r in order), key=lambda r: r[3]) == _brute([(1, half + half)])
    assert max(r.common for r in order) == 3000
