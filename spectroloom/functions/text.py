"""Parsing and formatting of the text fields of result and parameter tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between_dots(s: Column) -> Column:
    """Text between the first and the last dot; the text itself if it has no two dots."""
    return F.when(s.rlike(r"(?s)\..*\."), F.regexp_extract(s, r"(?s)^[^.]*\.(.*)\.[^.]*$", 1)).otherwise(s)


def annotation(pre: Column, sequence: Column, post: Column) -> Column:
    return F.concat_ws(".", pre, sequence, post)


def parse_modifications(s: Column) -> Column:
    """``Name pos,Name pos`` as an array of (name, position)."""
    parts = F.filter(F.split(F.coalesce(s, F.lit("")), ","), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*(.*)\s+\d+\s*$", 1).alias("name"), F.regexp_extract(p, r"(\d+)\s*$", 1).cast("int").alias("position")))


def format_modifications(mods: Column) -> Column:
    return F.array_join(F.transform(mods, lambda m: F.concat(m["name"], F.lit(" "), m["position"].cast("string"))), ",")


def parse_composition(s: Column) -> Column:
    """``C(153) H(232)`` or ``C153H232`` as a map from element to count; absent counts are 1."""
    atoms = F.regexp_extract_all(s, F.lit(r"([0-9]*[A-Z][a-z]*\(?-?[0-9]*\)?)"), 1)
    pairs = F.transform(atoms, lambda a: F.struct(F.regexp_extract(a, r"^([0-9]*[A-Z][a-z]*)", 1), F.when(F.regexp_extract(a, r"(-?[0-9]+)\)?$", 1) == "", F.lit(1)).otherwise(F.regexp_extract(a, r"(-?[0-9]+)\)?$", 1).cast("int"))))
    return F.map_from_entries(pairs)


def format_composition(m: Column) -> Column:
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("("), e["value"].cast("string"), F.lit(")"))), " ")


def add_compositions(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def parse_deltas(s: Column) -> Column:
    """Inline mass deltas of a peptide such as ``PEPM+15.995K``: (position of the residue, delta)."""
    residues = F.regexp_extract_all(s, F.lit(r"([A-Z](?:[+-][0-9.]+)*)"), 1)
    each = F.transform(residues, lambda r, i: F.struct((i + 1).alias("position"), F.regexp_extract(r, r"([+-][0-9.]+)", 1).alias("delta")))
    return F.transform(F.filter(each, lambda e: e["delta"] != ""), lambda e: F.struct(e["position"].alias("position"), e["delta"].cast("double").alias("delta")))


def plain_peptide(s: Column) -> Column:
    return F.regexp_replace(s, r"[^A-Z]", "")


def ion_name(series: Column, index: Column, charge: Column, loss: Column) -> Column:
    """``b5``, ``y12-H2O``, ``y3(2+)``."""
    return F.concat(series, index.cast("string"), loss, F.when(charge > 1, F.concat(F.lit("("), charge.cast("string"), F.lit("+)"))).otherwise(F.lit("")))


def parse_ion(s: Column) -> Column:
    charge = F.regexp_extract(s, r"\((\d+)\+\)$", 1)
    return F.struct(
        F.regexp_extract(s, r"^([a-z])", 1).alias("series"), F.regexp_extract(s, r"^[a-z](\d+)", 1).cast("int").alias("index"),
        F.regexp_extract(s, r"(-[A-Z][A-Za-z0-9]*)", 1).alias("loss"), F.when(charge == "", F.lit(1)).otherwise(charge.cast("int")).alias("charge"),
    )


def native_id_value(s: Column, key: str) -> Column:
    """A value of ``key=value key=value`` text, null if it is absent."""
    return F.element_at(F.str_to_map(s, F.lit(" "), F.lit("=")), key)


def sha1_upper(s: Column) -> Column:
    return F.upper(F.sha1(s))


def build_date(version: Column) -> Column:
    """The day that the third number of a version counts from 2000-01-01."""
    return F.date_add(F.lit("2000-01-01").cast("date"), F.element_at(F.split(version, r"\."), 3).cast("int"))


def floor_tiny(x: Column, least: float = 9.99e-308) -> Column:
    return F.greatest(F.lit(least), x)


def cleavable(sequence: Column, position: Column, residues: str, after: bool = True) -> Column:
    """Whether an enzyme cuts after (or before) a 1-based position."""
    at = position if after else position + 1
    return F.substring(sequence, at, F.lit(1)).isin(*residues) if not isinstance(at, int) else F.substring(sequence, at, 1).isin(*residues)


def decoy_reverse(sequence: Column, keep_last: str = "") -> Column:
    """Reversed; with ``keep_last``, residues of that set stay where the enzyme cuts."""
    if not keep_last:
        return F.reverse(sequence)
    pieces = F.regexp_extract_all(sequence, F.lit(f"([^{keep_last}]*[{keep_last}]?)"), 1)
    turned = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.when(F.right(p, F.lit(1)).isin(*keep_last), F.concat(F.reverse(F.substring(p, F.lit(1), F.length(p) - 1)), F.right(p, F.lit(1)))).otherwise(F.reverse(p)))
    return F.array_join(turned, "")


def decoy_shuffle(sequence: Column, seed: Column) -> Column:
    """A permutation of the letters by a seeded hash of letter and place: the same in every run."""
    letters = F.filter(F.split(sequence, ""), lambda r: r != "")
    keyed = F.transform(letters, lambda r, i: F.struct(F.xxhash64(seed, i, r).alias("key"), i.alias("i"), r.alias("r")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda k: k["r"]), "")
