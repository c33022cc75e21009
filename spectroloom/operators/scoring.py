"""Fragment matching, linear and rank scores, best paths and generating functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectroloom.operators.joins import band_join


# Weights of the composite score, each times 4: a match's offset and least score, a cleavage with fragments on
# both sides, and of a fragment on either side its count, intensity over the spectrum's reference (at most 1), the correlation
# and distance of its envelope, and its error in ppm.
SCALE, OFFSET, LEAST_SCORE, COMPLEMENTARY = 4.0, -5.39335774417474, 3.0, -0.378768218613132
PREFIX = {"count": -1.125486077, "intensity": 0.323923971, "corr": 1.473096149, "dist": 0.179502658, "error": -0.032959575}
SUFFIX = {"count": -0.886170429, "intensity": 0.372673677, "corr": 1.18929338, "dist": -0.284321389, "error": -0.026141488}
# The fragment series of each way to break molecules; b and y for all others.
SERIES = {"ETD": ("c", "z"), "UVPD": ("a", "b", "c", "x", "y", "z")}


def series_of(activation: Column) -> Column:
    """The fragment series of an activation as an array."""
    out = F.array(F.lit("b"), F.lit("y"))
    for name, series in SERIES.items():
        out = F.when(activation == name, F.array(*map(F.lit, series))).otherwise(out)
    return out


def composite_term(prefix: Column, intensity: Column, reference: Column, corr: Column, dist: Column, error_ppm: Column) -> Column:
    """What one matched fragment adds to the composite score."""
    def side(w: dict[str, float]) -> Column:
        share = F.when(reference > 0, F.least(intensity / reference, F.lit(1.0))).otherwise(F.lit(1.0))
        return (w["count"] + w["intensity"] * share + w["corr"] * corr + w["dist"] * dist + w["error"] * F.abs(error_ppm)) * SCALE

    return F.when(prefix, side(PREFIX)).otherwise(side(SUFFIX))


def composite_value(prefix: bool, intensity: np.ndarray, reference: float, corr: np.ndarray, dist: np.ndarray, error_ppm: np.ndarray) -> np.ndarray:
    """``composite_term`` of arrays."""
    w = PREFIX if prefix else SUFFIX
    share = np.minimum(intensity / reference, 1.0) if reference > 0 else np.ones_like(intensity)
    return (w["count"] + w["intensity"] * share + w["corr"] * corr + w["dist"] * dist + w["error"] * np.abs(error_ppm)) * SCALE


def composite_sites(matched: DataFrame, by: Sequence[str], length: str) -> DataFrame:
    """A row for each cleavage of a match that some fragment shows: ``site`` (residues before it), ``site_score``,
    ``plain_score`` (without mass errors, a whole number) and ``n``.

    ``matched`` has ``prefix``, ``cut`` (residues of the fragment), ``term`` and ``plain_term`` for each matched fragment.
    """
    site = F.when(F.col("prefix"), F.col("cut")).otherwise(F.col(length) - F.col("cut"))
    both = F.when(F.bool_or("prefix") & F.bool_or(~F.col("prefix")), F.lit(COMPLEMENTARY * SCALE)).otherwise(F.lit(0.0))
    return matched.groupBy(*by, site.alias("site")).agg((F.sum("term") + both).alias("site_score"), F.bround(F.sum("plain_term") + both).cast("long").alias("plain_score"), F.count("*").alias("n"))


def composite(matched: DataFrame, by: Sequence[str], length: str) -> DataFrame:
    """by with ``score``, ``plain_score`` and ``n_matched``: the sums over the cleavages of a match."""
    return composite_sites(matched, by, length).groupBy(*by).agg(F.sum("n").alias("n_matched"), F.sum("site_score").alias("score"), F.sum("plain_score").alias("plain_score"))


def probability(score: Column) -> Column:
    """That a match of this composite score is right, by the logistic curve of the offset."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(score + OFFSET * SCALE)))


def best_additive_placement(sequence: str, modifications: Sequence[str], sites: dict[str, str], shown: dict[tuple[int, tuple[str, ...]], tuple[float, int, int]]) -> tuple[float, int, int, list[str]] | None:
    """(score, plain score, matched fragments, modification or empty of each residue) of the placement that scores best.

    ``shown`` gives what the cleavage behind a number of residues, with these modifications before it, adds to each.
    Placements that agree in what is placed so far meet, so that only the best of them goes on. None if nothing is shown.
    """
    whole = tuple(sorted(modifications))
    states: dict[tuple[str, ...], tuple] = {(): (0.0, 0, 0, None)}
    for i, residue in enumerate(sequence, 1):
        after: dict[tuple[str, ...], tuple] = {}
        for done, (score, plain, n, path) in states.items():
            for m in ["", *[m for m in sorted(set(whole)) if residue in sites[m] and done.count(m) < whole.count(m)]]:
                now = tuple(sorted((*done, m))) if m else done
                a, b, c = shown.get((i, now), (0.0, 0, 0)) if i < len(sequence) else (0.0, 0, 0)
                new = (score + a, plain + b, n + c, (path, i, m) if m else path)
                if now not in after or new[:3] > after[now][:3]:
                    after[now] = new
        states = after
    if whole not in states or not states[whole][2]:
        return None
    score, plain, n, path = states[whole]
    placed = [""] * len(sequence)
    while path:
        path, i, m = path
        placed[i - 1] = m
    return score, plain, n, placed


def placed_composite(matched: DataFrame, by: Sequence[str], sites: dict[str, str]) -> DataFrame:
    """``composite`` of the best placement of each match's modifications, and ``placement``.

    ``matched`` has for each fragment and each ``part`` of the match's ``modifications`` that it may carry its terms, and the
    match's ``sequence``. A match is one row for the task that places it.
    """
    schema = ", ".join(f"{k} {matched.schema[k].dataType.simpleString()}" for k in by) + ", n_matched long, score double, plain_score long, placement array<string>"
    rows = F.sort_array(F.collect_list(F.struct("prefix", "cut", F.array_join("part", "|").alias("part"), "term", "plain_term")))
    matches = matched.groupBy(*by).agg(F.first("sequence").alias("_sequence"), F.array_join(F.first("modifications"), "|").alias("_whole"), rows.alias("_r"))
    matches = matches.select(*by, "_sequence", "_whole", *[F.col(f"_r.{c}").alias(f"_{c}") for c in ("prefix", "cut", "part", "term", "plain_term")])

    def split(names: str) -> list[str]:
        return names.split("|") if names else []

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                head, (sequence, whole, *columns) = row[: len(by)], row[len(by) :]
                cells: dict[tuple, list] = {}
                for prefix, cut, part, term, plain in zip(*columns, strict=True):
                    before = split(part)
                    if not prefix:
                        before = split(whole)
                        for m in split(part):
                            before.remove(m)
                    cell = cells.setdefault((int(cut) if prefix else len(sequence) - int(cut), tuple(sorted(before))), [0.0, 0.0, 0, set()])
                    cell[0], cell[1], cell[2] = cell[0] + term, cell[1] + plain, cell[2] + 1
                    cell[3].add(bool(prefix))
                both = COMPLEMENTARY * SCALE
                shown = {k: (t + both * (len(s) == 2), int(np.rint(p + both * (len(s) == 2))), n) for k, (t, p, n, s) in cells.items()}
                found = best_additive_placement(sequence, split(whole), sites, shown)
                if found:
                    out.append([*head, found[2], found[0], found[1], found[3]])
            yield pd.DataFrame(out, columns=[*by, "n_matched", "score", "plain_score", "placement"])

    return matches.mapInPandas(run, schema)


def match_fragments(fragments: DataFrame, peaks: DataFrame, ion_mz: str, peak_mz: str, intensity: str, ppm: float, id_columns: Sequence[str], keys: Sequence[str] = (), take: Sequence[str] = ()) -> DataFrame:
    """Each fragment with its strongest peak within ``ppm``: id_columns, peak_mz, intensity, error in ppm and ``take`` of the peak."""
    pairs = band_join(fragments, peaks, ion_mz, peak_mz, ppm, "ppm", keys)
    best = pairs.groupBy(*id_columns, ion_mz).agg(F.max(F.struct(F.col(intensity).alias("i"), F.col(peak_mz).alias("m"), *take)).alias("b"))
    return best.select(*id_columns, ion_mz, F.col("b.m").alias("matched_mz"), F.col("b.i").alias("matched_intensity"), ((F.col("b.m") - F.col(ion_mz)) / F.col(ion_mz) * 1e6).alias("error_ppm"), *[F.col(f"b.{c}").alias(c) for c in take])


def composite_score(matched: DataFrame, by: Sequence[str], weights: dict[str, float], reference: Column) -> DataFrame:
    """A linear score of matched fragments: count, log intensity over ``reference`` and mass error.

    ``weights``: count, intensity, error, offset.
    """
    strength = F.log2(1 + F.col("matched_intensity") / reference)
    return matched.groupBy(*by).agg(
        F.count("*").alias("n_matched"), F.sum(strength).alias("strength"), F.avg(F.abs("error_ppm")).alias("mean_error"),
    ).withColumn("score", weights.get("offset", 0.0) + F.col("n_matched") * weights.get("count", 1.0) + F.col("strength") * weights.get("intensity", 0.0) + F.col("mean_error") * weights.get("error", 0.0))


def best_placement(sequence: str, modifications: Sequence[str], hits: dict[tuple[int, tuple[str, ...]], tuple[int, float]], sites: dict[str, str], count: float, error: float) -> tuple[float, list[str]] | None:
    """(score, modification or empty of each residue) of the placement that scores best; None if none has a hit.

    ``hits`` gives for the cleavage behind a number of residues, and the sorted modifications before
    it, how many fragments match and the sum of their errors. The score is ``count`` times all
    matches plus ``error`` (not positive) times their mean error, so that for each number of
    matches the least sum of errors is enough: placements that agree in what is placed meet.
    """
    whole = tuple(sorted(modifications))
    states: dict[tuple[tuple[str, ...], int], tuple[float, tuple | None]] = {((), 0): (0.0, None)}
    for i, residue in enumerate(sequence, 1):
        after: dict[tuple[tuple[str, ...], int], tuple[float, tuple | None]] = {}
        for (done, n), (total, path) in states.items():
            for m in ["", *[m for m in sorted(set(whole)) if residue in sites[m] and done.count(m) < whole.count(m)]]:
                now = tuple(sorted((*done, m))) if m else done
                more, errors = hits.get((i, now), (0, 0.0)) if i < len(sequence) else (0, 0.0)
                key = (now, n + more)
                if key not in after or total + errors < after[key][0]:
                    after[key] = (total + errors, (path, i, m) if m else path)
        states = after
    ends = [(n * count + error * total / n, n, path) for (done, n), (total, path) in states.items() if done == whole and n]
    if not ends:
        return None
    score, _, path = max(ends, key=lambda x: x[:2])
    placed = [""] * len(sequence)
    while path:
        path, i, m = path
        placed[i - 1] = m
    return score, placed


def placed_score(matched: DataFrame, by: Sequence[str], sites: dict[str, str], weights: dict[str, float], reference: float) -> DataFrame:
    """``composite_score`` of the best placement of each match's modifications, and ``placement``.

    ``matched`` has for each fragment (``ion`` b or y, ``cut``) and each ``part`` of the match's
    ``modifications`` that it may carry its peak, and the match's ``sequence``. ``weights``: count, error, offset.
    """
    schema = ", ".join(f"{k} {matched.schema[k].dataType.simpleString()}" for k in by) + ", n_matched long, strength double, mean_error double, score double, placement array<string>"

    def before(row, n: int, whole: list[str]) -> tuple[int, tuple[str, ...]]:
        part = list(row.part)
        if row.ion == "b":
            return int(row.cut), tuple(sorted(part))
        rest = list(whole)
        for m in part:
            rest.remove(m)
        return n - int(row.cut), tuple(sorted(rest))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sequence, whole = group["sequence"].iloc[0], list(group["modifications"].iloc[0])
        rows = [(before(r, len(sequence), whole), abs(r.error_ppm), r.matched_intensity) for r in group.sort_values(["ion", "cut", "fragment_mass"]).itertuples(index=False)]
        hits: dict = {}
        for at, error, _ in rows:
            n, total = hits.get(at, (0, 0.0))
            hits[at] = (n + 1, total + error)
        found = best_placement(sequence, whole, hits, sites, weights.get("count", 1.0), weights.get("error", 0.0))
        if found is None:
            return pd.DataFrame([], columns=[*by, "n_matched", "strength", "mean_error", "score", "placement"])
        score, placed = found
        chosen = {(i, tuple(sorted(m for m in placed[:i] if m))) for i in range(1, len(sequence))}
        used = [(e, x) for at, e, x in rows if at in chosen]
        strength = sum(np.log2(1 + x / reference) for _, x in used)
        out = [*(group[k].iloc[0] for k in by), len(used), strength, sum(e for e, _ in used) / len(used), score + weights.get("offset", 0.0), placed]
        return pd.DataFrame([out], columns=[*by, "n_matched", "strength", "mean_error", "score", "placement"])

    return matched.groupBy(*by).applyInPandas(run, schema)


def complementary_pairs(matched: DataFrame, by: Sequence[str], cut: str, length: str, prefix: str) -> DataFrame:
    """How many cleavages have both their prefix and their suffix fragment."""
    site = F.when(F.col(prefix), F.col(cut)).otherwise(F.col(length) - F.col(cut))
    per_site = matched.withColumn("_site", site).groupBy(*by, "_site").agg(F.bool_or(F.col(prefix)).alias("_p"), F.bool_or(~F.col(prefix)).alias("_s"))
    return per_site.groupBy(*by).agg(F.count_if(F.col("_p") & F.col("_s")).alias("complementary"), F.count("*").alias("sites"))


def rank_score(matched: DataFrame, table: DataFrame, keys: Sequence[str], rank: str, least: float = 1e-10) -> Column | DataFrame:
    """``matched`` with ``rank_score``: log of target over decoy frequency at its rank, 0 if either is tiny.

    ``table`` has keys, rank, target, decoy; its size is that of an ion-type table.
    """
    score = F.when((F.col("target") < least) | (F.col("decoy") < least) | F.col("target").isNull(), F.lit(0.0)).otherwise(F.log(F.col("target") / F.col("decoy")))
    return matched.join(table, [*keys, rank], "left").withColumn("rank_score", score).drop("target", "decoy")


def error_likelihood(error: Column, target: tuple[float, float], noise: tuple[float, float]) -> Column:
    """Log ratio of two normal densities of a mass error, each (mean, standard deviation)."""
    log_density = lambda m, s: -F.pow((error - m) / s, F.lit(2.0)) / 2 - F.log(F.lit(s))
    return log_density(*target) - log_density(*noise)


def table_likelihood(features: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``features`` with the sum of looked-up scores: ``table`` has keys, ``name``, ``bin`` and ``score``,
    ``features`` an array column ``bins`` of (name, bin)."""
    each = features.select("*", F.explode("bins").alias("_b")).withColumn("name", F.col("_b.name")).withColumn("bin", F.col("_b.bin"))
    found = each.join(table, [*keys, "name", "bin"], "left").groupBy("feature_id").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("likelihood"))
    return features.join(found, "feature_id", "left")


def score_distribution(node_scores: np.ndarray, steps: np.ndarray, weights: np.ndarray, target: int) -> tuple[int, np.ndarray]:
    """(least score, probabilities) of all residue sequences of nominal mass ``target``.

    ``node_scores`` gives the integer score of a cleavage at each nominal mass, ``steps`` the
    residues' nominal masses, ``weights`` their probabilities. The least and the highest score that
    any sequence can have are found first. Distributions of reachable masses are convolved upwards,
    and only as many are kept as the heaviest residue reaches back.
    """
    steps = np.asarray(steps, np.int64)
    best, worst = np.full(target + 1, -np.inf), np.full(target + 1, np.inf)
    best[0] = worst[0] = 0
    for m in range(1, target + 1):
        back = m - steps[steps <= m]
        s = int(node_scores[m]) if m < target else 0
        if len(back):
            best[m], worst[m] = best[back].max() + s, worst[back].min() + s
    if not np.isfinite(best[target]):
        return 0, np.zeros(1)
    reached = np.isfinite(best)
    low, high = int(min(0, worst[reached].min())), int(max(0, best[reached].max()))
    size, depth = high - low + 1, int(steps.max()) + 1
    table = np.zeros((depth, size))
    table[0, -low] = 1.0
    for m in range(1, target + 1):
        row = np.zeros(size)
        for step, w in zip(steps, weights, strict=True):
            if step <= m:
                row += w * table[(m - step) % depth]
        s = int(node_scores[m]) if m < target else 0
        if abs(s) >= size:
            row[:] = 0  # no sequence that gets here can go on
        elif s > 0:
            row[s:] = row[: size - s].copy()
            row[:s] = 0
        elif s < 0:
            row[:s] = row[-s:].copy()
            row[s:] = 0
        table[m % depth] = row
    return low, table[target % depth]


def tail_probability(low: int, p: np.ndarray, score: int) -> float:
    """P(score or more) among sequences of the mass; 1 if there are none, the least positive value if none scores so."""
    total = p.sum()
    if not total:
        return 1.0
    return float(max(p[min(len(p), max(0, score - low)) :].sum() / total, 1e-300))


def generating_function(spectra: DataFrame, keys: Sequence[str], mass: str, nodes: str, score: str, residues: dict[str, float]) -> DataFrame:
    """keys with ``spec_e_value``: ``mass`` is the nominal target, ``nodes`` an array of (mass, score), ``score`` the match's.

    Rows are independent of each other, so that they spread over the cluster as they are. Rows of
    equal target and nodes that a task meets share one distribution while it is among the last ones.
    """
    schema = ", ".join(f"{k} {spectra.schema[k].dataType.simpleString()}" for k in keys) + ", spec_e_value double"
    steps = np.array([int(round(m * 0.9995)) for m in residues.values()])
    weights = np.full(len(steps), 1 / len(steps))

    def run(frames):
        @lru_cache(maxsize=128)
        def distribution(target: int, scores: bytes) -> tuple[int, np.ndarray]:
            return score_distribution(np.frombuffer(scores, int), steps, weights, target)

        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                target = int(getattr(row, mass))
                scores = np.zeros(target + 1, int)
                for n in getattr(row, nodes):
                    if 0 < n["mass"] < target:
                        scores[n["mass"]] = n["score"]
                low, p = distribution(target, scores.tobytes())
                out.append([getattr(row, k) for k in keys] + [tail_probability(low, p, int(getattr(row, score)))])
            yield pd.DataFrame(out, columns=[*keys, "spec_e_value"])

    return spectra.select(*keys, mass, nodes, score).mapInPandas(run, schema)


def best_path(residues: np.ndarray, options: list[list[float]], observed: np.ndarray, tolerance: float) -> tuple[float, list[int]]:
    """Best number of observed prefix masses over all placements of modifications (max-plus).

    ``options`` gives for each residue the mass shifts that it can carry, 0 first; total shift is
    free. A state is a sum of shifts, so equal sums meet.
    """
    states: dict[float, tuple[float, list[int]]] = {0.0: (0.0, [])}
    prefix = 0.0
    for mass, shifts in zip(residues, options, strict=True):
        prefix += mass
        after: dict[float, tuple[float, list[int]]] = {}
        for shift, (score, path) in states.items():
            for k, more in enumerate(shifts):
                total = round(shift + more, 6)
                hit = float(np.any(np.abs(observed - prefix - total) <= tolerance))
                if total not in after or score + hit > after[total][0]:
                    after[total] = (score + hit, [*path, k])
        states = after
    return max(states.values(), key=lambda s: s[0])


def score_proteoforms(pairs: DataFrame, keys: Sequence[str], sequence: str, prefixes: str, masses: dict[str, float], sites: dict[str, str], tolerance: float) -> DataFrame:
    """keys with ``path_score`` and ``placement`` (modification or empty, for each residue)."""
    from spectroloom.functions.mass import RESIDUE_MASS

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", path_score double, placement array<string>"

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                letters = getattr(row, sequence) or ""
                names = [["", *[m for m in sorted(masses) if r in sites[m]]] for r in letters]
                score, path = best_path(np.array([RESIDUE_MASS.get(r, 0.0) for r in letters]), [[masses.get(n, 0.0) for n in opts] for opts in names], np.asarray(getattr(row, prefixes), float), tolerance) if letters else (0.0, [])
                out.append([getattr(row, k) for k in keys] + [score, [n[i] for n, i in zip(names, path, strict=True)]])
            yield pd.DataFrame(out, columns=[*keys, "path_score", "placement"])

    return pairs.select(*keys, sequence, prefixes).mapInPandas(run, schema)


def spectrum_similarity(a: DataFrame, b: DataFrame, keys: Sequence[str], mz_bin: str, intensity: str) -> DataFrame:
    """Dot product, cosine and shared bins of spectra with equal keys, absent bins 0."""
    x = a.select(*keys, mz_bin, F.col(intensity).alias("_x"))
    y = b.select(*keys, mz_bin, F.col(intensity).alias("_y"))
    both = x.join(y, [*keys, mz_bin], "full").fillna({"_x": 0.0, "_y": 0.0})
    xy, xx, yy = F.sum(F.col("_x") * F.col("_y")), F.sum(F.col("_x") * F.col("_x")), F.sum(F.col("_y") * F.col("_y"))
    return both.groupBy(*keys).agg(xy.alias("dot"), F.when(xx * yy > 0, xy / F.sqrt(xx * yy)).otherwise(F.lit(0.0)).alias("cosine"), F.count_if((F.col("_x") > 0) & (F.col("_y") > 0)).alias("shared"))
