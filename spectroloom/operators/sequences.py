"""Enumeration of sequences and proteoforms as table-generating operators.

All cuts are made with explode over generated positions, so that candidates stream out of a
protein's row and are never gathered.
"""

from __future__ import annotations

import json
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame, sequence: str, start: Column, stop: Column) -> DataFrame:
    """``df`` with pre, peptide, post and 1-based start, given 0-based start and stop columns."""
    seq = F.col(sequence)
    return df.select("*", start.alias("_a"), stop.alias("_b")).select(
        *[c for c in df.columns if not c.startswith("_")],
        F.when(F.col("_a") == 0, "-").otherwise(F.substring(seq, F.col("_a").cast("int"), F.lit(1))).alias("pre"),
        F.substring(seq, (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")).alias("peptide"),
        F.when(F.col("_b") >= F.length(seq), "-").otherwise(F.substring(seq, (F.col("_b") + 1).cast("int"), F.lit(1))).alias("post"),
        (F.col("_a") + 1).cast("long").alias("start"),
    )


def intact_sequences(proteins: DataFrame, sequence: str, least: int, most: int, c_trims: int = 0) -> DataFrame:
    """Whole proteins and those with up to ``c_trims`` residues off the end, by length."""
    n = F.length(sequence)
    cut = proteins.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(c_trims)))).where((n - F.col("_t")).between(least, most))
    return _cut(cut, sequence, F.lit(0), n - F.col("_t"))


def terminal_cleavages(proteins: DataFrame, sequence: str, least: int, most: int, n_trims: int, c_trims: int) -> DataFrame:
    """All sequences with any trim at the start and at most ``c_trims`` at the end, or any larger trim at
    the end and at most ``n_trims`` at the start; each once."""
    n = F.length(sequence)
    long_enough = proteins.where(n >= least)
    front = long_enough.withColumn("_c", F.explode(F.sequence(F.lit(0), F.least(F.lit(c_trims), n - least)))).withColumn("_n", F.explode(F.sequence(F.lit(0), n - F.col("_c") - least)))
    back = long_enough.where(n - least > c_trims).withColumn("_c", F.explode(F.sequence(F.lit(c_trims + 1), n - least))).withColumn("_n", F.explode(F.sequence(F.lit(0), F.least(F.lit(n_trims), n - F.col("_c") - least))))
    both = front.unionByName(back).where((n - F.col("_c") - F.col("_n")).between(least, most))
    return _cut(both, sequence, F.col("_n"), n - F.col("_c"))


def all_substrings(proteins: DataFrame, sequence: str, least: int, most: int, distinct: bool = False) -> DataFrame:
    """Every substring by length; ``distinct`` keeps one for each preceding residue and sequence."""
    n = F.length(sequence)
    starts = proteins.where(n >= least).withColumn("_n", F.explode(F.sequence(F.lit(0), n - least)))
    ends = starts.withColumn("_e", F.explode(F.sequence(F.col("_n") + least, F.least(n, F.col("_n") + most))))
    cut = _cut(ends, sequence, F.col("_n"), F.col("_e"))
    return cut.dropDuplicates(["pre", "peptide"]) if distinct else cut


def digested(proteins: DataFrame, sequence: str, residues: str, least: int, most: int, missed: int = 1, termini: int = 2, after: bool = True) -> DataFrame:
    """Enzymatic peptides: at least ``termini`` (0 to 2) ends at cuts, at most ``missed`` cuts inside.

    Ends of the protein count as cuts. ``missed_cleavages`` counts the cuts inside.
    """
    n = F.length(sequence)
    marks = F.transform(F.sequence(F.lit(1), n - 1), lambda p: F.when(F.substring(F.col(sequence), (p if after else p + 1).cast("int"), F.lit(1)).isin(*residues), p))
    sites = proteins.where(n >= least).withColumn("_sites", F.when(n > 1, F.filter(marks, lambda p: p.isNotNull())).otherwise(F.array().cast("array<int>")))
    ends = F.array_sort(F.array_union(F.col("_sites"), F.array(F.lit(0), n)))
    if termini == 2:
        # pairs of cuts at most missed + 1 places apart
        pair = sites.withColumn("_cuts", ends).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_cuts") - 2)))
        pair = pair.withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.least(F.size("_cuts") - 1, F.col("_i") + 1 + missed))))
        placed = pair.withColumn("_n", F.get("_cuts", F.col("_i"))).withColumn("_e", F.get("_cuts", F.col("_j"))).drop("_cuts", "_i", "_j")
    else:
        start = sites.withColumn("_n", F.explode(F.sequence(F.lit(0), n - least)))
        placed = start.withColumn("_e", F.explode(F.sequence(F.col("_n") + least, F.least(n, F.col("_n") + most))))
        at_cut = lambda c: (F.array_contains("_sites", c) | (c == 0) | (c == n)).cast("int")
        placed = placed.where(at_cut(F.col("_n")) + at_cut(F.col("_e")) >= termini)
    inside = F.size(F.filter("_sites", lambda p: (p > F.col("_n")) & (p < F.col("_e"))))
    placed = placed.where((F.col("_e") - F.col("_n")).between(least, most)).withColumn("missed_cleavages", inside).where(F.col("missed_cleavages") <= missed)
    return _cut(placed, sequence, F.col("_n"), F.col("_e"))


def suffix_order(proteins: DataFrame, protein: str, sequence: str, most: int) -> DataFrame:
    """(protein, start, suffix, common): all suffixes in lexicographic order, cut at ``most`` residues (the longest
    sequence that is looked for), with how many residues each shares with the one before it.

    Suffixes are sorted in ranges and written; the first of a range is compared with the last of the range before, of
    which there is one row a range. Equal suffixes follow by protein and start.
    """
    from pyspark.sql import Window

    from spectroloom.operators.scratch import materialised

    keys = ["suffix", protein, "start"]
    each = proteins.where(F.length(sequence) > 0).select(protein, F.explode(F.sequence(F.lit(1), F.length(sequence))).alias("start"), sequence)
    each = each.select(protein, "start", F.substring(F.col(sequence), F.col("start"), F.lit(most)).alias("suffix"))
    ranged = materialised(each.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    ends = ranged.groupBy("_part").agg(F.max("suffix").alias("_end"))
    last = ends.select((F.col("_part")).alias("_p"), F.lag("_end").over(Window.partitionBy(F.lit(0)).orderBy("_part")).alias("_end"))
    w = Window.partitionBy("_part").orderBy(*keys)
    # one row a range is broadcast
    with_last = ranged.join(F.broadcast(last), F.col("_part") == F.col("_p")).withColumn("_before", F.coalesce(F.lag("suffix").over(w), "_end", F.lit("")))
    shorter = F.least(F.length("suffix"), F.length("_before"))
    same = F.aggregate(F.sequence(F.lit(1), shorter), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(F.col("suffix"), i, F.lit(1)) == F.substring(F.col("_before"), i, F.lit(1))), i).otherwise(n))
    return with_last.select(protein, "start", "suffix", F.when(shorter > 0, same).otherwise(0).alias("common"))


def modification_combinations(names: list[str], most: int) -> list[tuple[str, ...]]:
    """All sorted multisets of up to ``most`` modifications, the empty one first."""
    return [c for k in range(most + 1) for c in combinations_with_replacement(sorted(names), k)]


def site_counts(sequence: Column, sites: dict[str, str]) -> Column:
    """How many residues each modification can sit on, as a map."""
    pairs = []
    for name, residues in sorted(sites.items()):
        pairs += [F.lit(name), F.length(sequence) - F.length(F.regexp_replace(sequence, f"[{residues}]", ""))]
    return F.create_map(*pairs)


def modification_parts(combos: list[tuple[str, ...]], masses: dict[str, float]) -> list[tuple[list[str], list[tuple[list[str], float]]]]:
    """Each combination with all that a fragment can carry of it: (modifications, [(part, mass shift)])."""
    parts = lambda c: sorted({p for k in range(len(c) + 1) for p in combinations(c, k)})
    return [(list(c), [(list(p), float(sum(masses[m] for m in p))) for p in parts(c)]) for c in combos]


def site_needs(combination: tuple[str, ...], sites: dict[str, str]) -> list[tuple[str, int]]:
    """Hall's condition for each set of a combination's own names: (residues, how many of them the set needs)."""
    names = sorted(set(combination))
    chosen = [c for k in range(1, len(names) + 1) for c in combinations(names, k)]
    return [("".join(sorted(set("".join(sites[n] for n in c)))), sum(combination.count(n) for n in c)) for c in chosen]


def proteoforms(sequences: DataFrame, sequence: str, masses: dict[str, float], sites: dict[str, str], most: int) -> DataFrame:
    """``sequences`` with ``modifications`` (a sorted array) and ``mass`` for each combination that fits.

    A combination fits if its modifications find sites of their own; modifications that share
    residues are counted together. Null sequences give no row.
    """
    from spectroloom.functions.mass import WATER, residue_mass

    rows = [{"modifications": list(c), "shift": float(sum(masses[m] for m in c)), "needs": [{"residues": r, "need": n} for r, n in site_needs(c, sites)]} for c in modification_combinations(list(masses), most)]
    # the combinations are one constant of the plan: each sequence's row is taken by those that fit it, without a join
    every = F.from_json(F.lit(json.dumps(rows)), "array<struct<modifications:array<string>,shift:double,needs:array<struct<residues:string,need:int>>>>")
    room = lambda residues: F.length(sequence) - F.length(F.call_function("translate", F.col(sequence), residues, F.lit("")))
    fitting = F.filter(every, lambda c: F.forall(c["needs"], lambda n: n["need"] <= room(n["residues"])))
    pairs = sequences.withColumn("_mass", residue_mass(F.col(sequence)) + WATER).withColumn("_c", F.explode(fitting))
    return pairs.withColumn("modifications", F.col("_c.modifications")).withColumn("mass", F.col("_mass") + F.col("_c.shift")).drop("_mass", "_c")


def fragments(sequences: DataFrame, sequence: str, series: tuple[str, ...] = ("b", "y"), charges: tuple[int, int] = (1, 1)) -> DataFrame:
    """``sequences`` with a row for each cleavage, series and charge: ``ion``, ``cut`` (residues of the fragment), ``charge``, ``fragment_mass``, ``ion_mz``."""
    from spectroloom.functions.mass import ION_SERIES, PROTON
    from spectroloom.functions.numeric import prefix_masses

    n = F.length(sequence)
    cuts = sequences.where(n > 1).withColumn("_up", prefix_masses(F.col(sequence))).withColumn("cut", F.explode(F.sequence(F.lit(1), n - 1)))
    parts = F.array(*[F.struct(F.lit(s).alias("ion"), F.lit(ION_SERIES[s][0] == "prefix").alias("prefix"), F.lit(ION_SERIES[s][1]).alias("offset")) for s in series])
    each = cuts.withColumn("_s", F.explode(parts))
    piece = F.when(F.col("_s.prefix"), F.get("_up", F.col("cut"))).otherwise(F.get("_up", n) - F.get("_up", n - F.col("cut")))
    each = each.withColumn("fragment_mass", piece + F.col("_s.offset")).withColumn("charge", F.explode(F.sequence(F.lit(charges[0]), F.lit(charges[1]))))
    return each.withColumn("ion", F.col("_s.ion")).withColumn("ion_mz", F.col("fragment_mass") / F.col("charge") + PROTON).drop("_s", "_up")
