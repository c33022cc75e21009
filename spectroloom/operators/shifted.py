"""Proteins around sequence tags with modifications and an unknown mass at either end.

A tag on a protein fixes the masses on its two sides. From the tag outwards every cleavage has a known mass for each set
of modifications placed so far, whatever hangs on the protein's end, so the best placement is a max-plus programme over
(residues away from the tag, modifications placed); what mass is left at the end is the shift of that terminus. A
spectrum and its tags are one group; proteins of n residues take time in proportion to n for each tag and set.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.functions.mass import ION_SERIES, RESIDUE_MASS
from spectroloom.operators import scoring

Node = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def cleavage_scores(mass: np.ndarray, intensity: np.ndarray, corr: np.ndarray, dist: np.ndarray, series: Sequence[str], whole: float, ppm: float) -> Node:
    """What gives cleavages, by the residue mass before them, their composite scores and matched fragments, from the
    peaks of a spectrum (by mass); ``whole`` is the residue mass of all."""
    reference = float(np.sort(intensity)[int(len(intensity) * 0.875)]) if len(intensity) else 0.0

    def node(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score, n, sides = np.zeros(prefix.shape), np.zeros(prefix.shape, int), [np.zeros(prefix.shape, bool), np.zeros(prefix.shape, bool)]
        for ion in series:
            first = ion in ("a", "b", "c")
            target = (prefix if first else whole - prefix) + ION_SERIES[ion][1]
            low, high = np.searchsorted(mass, target * (1 - ppm / 1e6)), np.searchsorted(mass, target * (1 + ppm / 1e6), "right")
            best = np.full(prefix.shape, -1)
            for d in range(int((high - low).max(initial=0))):  # the strongest peak in reach
                i = np.minimum(low + d, len(mass) - 1)
                best = np.where((low + d < high) & ((best < 0) | (intensity[i] > intensity[best])), i, best)
            hit = (best >= 0) & (target > 0)
            error = np.abs(mass[best] - target) / np.where(target > 0, target, 1.0) * 1e6 if len(mass) else 0.0
            if len(mass):
                score += np.where(hit, scoring.composite_value(first, intensity[best], reference, corr[best], dist[best], error), 0.0)
            n += hit
            sides[not first] |= hit
        return score + np.where(sides[0] & sides[1], scoring.COMPLEMENTARY * scoring.SCALE, 0.0), n

    return node


def best_side(residues: str, flank: float, node: Node, modifications: dict[str, tuple[float, str]], most: int, shifts: Sequence[float], unknown: tuple[float, float] | None, da: float) -> tuple[float, int, int, float, list[str]] | None:
    """(score, matched fragments, residues taken, shift, modification or empty of each) of the best end of one side.

    ``residues`` go away from the tag, ``flank`` is their side's mass and ``node`` takes what is left of it behind a
    cleavage. An end is good where one of ``shifts`` is left, and the protein's own end where the rest lies in ``unknown``.
    Of equal scores the end with fewer modifications counts, then that with the smaller shift. None if no end is good.
    """
    sets = [c for r in range(most + 1) for c in combinations_with_replacement(sorted(modifications), r)]
    place, extra = {c: k for k, c in enumerate(sets)}, np.array([sum(modifications[m][0] for m in c) for c in sets])
    reach = flank + max([0.0, *(-s for s in shifts), -(unknown or (0.0, 0.0))[0]]) - min(0.0, float(extra.min())) + da
    cum = np.concatenate([[0.0], np.cumsum([RESIDUE_MASS.get(r, 0.0) for r in residues])])
    n = int(np.searchsorted(cum, reach, "right")) - 1
    left = flank - cum[None, : n + 1] - extra[:, None]
    score, count = node(left)
    f, g, took = np.full((len(sets), n + 1), -np.inf), np.full((len(sets), n + 1), -np.inf), np.full((len(sets), n + 1), -1)
    f[0, 0] = g[0, 0] = 0.0
    steps = [[(k, place[tuple(c[:j] + c[j + 1 :])], m) for j, m in enumerate(c) if not j or c[j - 1] != m] for k, c in enumerate(sets)]
    names = sorted(modifications)
    for i in range(1, n + 1):
        g[:, i] = f[:, i - 1]
        for moves in steps:
            for k, before, m in moves:
                if residues[i - 1] in modifications[m][1] and f[before, i - 1] > g[k, i]:
                    g[k, i], took[k, i] = f[before, i - 1], names.index(m)
        f[:, i] = g[:, i] + score[:, i]
    gap = np.min([np.abs(left - s) for s in shifts], axis=0) if shifts else np.full(left.shape, np.inf)
    good = gap <= da
    if unknown and n == len(residues):
        good[:, n] |= (left[:, n] >= unknown[0]) & (left[:, n] <= unknown[1])
    good &= g > -np.inf
    if not good.any():
        return None
    k, i = min(zip(*(x.tolist() for x in np.nonzero(good)), strict=True), key=lambda at: (-round(float(g[at]), 9), len(sets[at[0]]), abs(float(left[at])), at[1]))
    shift, total, end, placed, matched = float(left[k, i]), float(g[k, i]), i, [""] * i, 0
    while i:
        if i < end:
            matched += int(count[k, i])
        if took[k, i] >= 0:
            m = names[took[k, i]]
            placed[i - 1] = m
            c = list(sets[k])
            c.remove(m)
            k = place[tuple(c)]
        i -= 1
    return total, matched, end, shift if min([abs(shift - s) for s in shifts], default=np.inf) > da else min(shifts, key=lambda s: abs(shift - s)), placed


def shifted_matches(hits: DataFrame, peaks: DataFrame, proteins: DataFrame, modifications: dict[str, tuple[float, str]] | None = None, most: int = 0, shifts: Sequence[float] = (0.0,), unknown: tuple[float, float] | None = None, ppm: float = 10.0, da: float = 0.01, activation: str = "CID") -> DataFrame:
    """(scan_num, name, start, stop, sequence, left_shift, right_shift, placement, n_matched, score) of tags on proteins.

    ``hits`` are scan_num, name, position (from 0), tag, before and after (residue masses on its sides); ``peaks`` are
    deconvoluted (scan_num, mass, intensity, corr and dist if known). Up to ``most`` of ``modifications`` (name to mass
    shift and residues) are placed on each side; one of ``shifts`` may be left at an end, and at a protein's own end any
    mass within ``unknown``. Fragments count with what is placed and left before them. Each hit gives its best match, of
    equal ones one row; hits without a good end or a peak, and those with nulls, give none.
    """
    modifications, series = modifications or {}, scoring.SERIES.get(activation.upper(), ("b", "y"))
    one = lambda name, default: F.col(name) if name in peaks.columns else F.lit(default).alias(name)
    seen = peaks.select("scan_num", "mass", F.col("intensity").cast("double").alias("intensity"), one("corr", 1.0), one("dist", 0.0)).where("mass IS NOT NULL")
    placed = hits.select("scan_num", "name", "position", "tag", "before", "after").dropna().join(proteins.select("name", "sequence").dropna(), "name").select(F.col("scan_num").alias("scan"), "name", "position", "tag", "before", "after", "sequence")
    schema = f"scan_num {hits.schema['scan_num'].dataType.simpleString()}, name string, start int, stop int, sequence string, left_shift double, right_shift double, placement array<string>, n_matched int, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def within(key: tuple, asked: pa.Table, spectrum: pa.Table) -> pa.Table:
        order = np.argsort(spectrum.column("mass").to_numpy(), kind="stable")
        columns = [spectrum.column(c).to_numpy()[order] for c in ("mass", "intensity", "corr", "dist")]
        rows = set()
        for h in asked.to_pylist() if len(order) else []:
            body = sum(RESIDUE_MASS.get(r, 0.0) for r in h["tag"])
            whole = h["before"] + body + h["after"]
            node = cleavage_scores(*columns, series, whole, ppm)
            p, q, s = h["position"], h["position"] + len(h["tag"]), h["sequence"]
            left = best_side(s[:p][::-1], h["before"], node, modifications, most, shifts, unknown, da)
            right = best_side(s[q:], h["after"], lambda rest, whole=whole, node=node: node(whole - rest), modifications, most, shifts, unknown, da)
            if left is None or right is None:
                continue
            inner = h["before"] + np.cumsum([0.0, *(RESIDUE_MASS.get(r, 0.0) for r in h["tag"])])
            inner = inner[int(left[2] == 0) : len(inner) - int(right[2] == 0)]
            score, n = node(inner)
            start, stop = p - left[2], q + right[2]
            rows.add((h["name"], start, stop, s[start:stop], round(left[3], 6), round(right[3], 6), (*left[4][::-1], *[""] * (q - p), *right[4]), left[1] + right[1] + int(n.sum()), round(left[0] + right[0] + float(score.sum()), 9)))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.int32(), pa.float64()]
        found = list(zip(*sorted(rows), strict=True)) if rows else [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(rows), key[0].type), *(pa.array([list(v) if isinstance(v, tuple) else v for v in c], k) for c, k in zip(found, kinds, strict=True))], names)

    return placed.groupBy("scan").cogroup(seen.groupBy("scan_num")).applyInArrow(within, schema)
