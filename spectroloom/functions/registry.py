"""The functions of this package as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from spectroloom.functions import numeric
from spectroloom.functions.mass import C13_MINUS_C12, FINE_SCALE, NOMINAL_SCALE, PROTON, RESIDUE_MASS, WATER

#: SQL functions without Python: name, arguments and expression.
EXPRESSIONS = (
    ("isotope_mz", "mass DOUBLE, charge INT, isotope INT", f"(mass + isotope * {C13_MINUS_C12!r}D) / charge + {PROTON!r}D"),
    ("mono_mass", "mz DOUBLE, charge INT, isotope INT", f"(mz - {PROTON!r}D) * charge - isotope * {C13_MINUS_C12!r}D"),
    ("nominal_bin", "mass DOUBLE", f"CAST(bround(mass * {NOMINAL_SCALE!r}D) AS BIGINT)"),
    ("fine_bin", "mass DOUBLE", f"CAST(bround(mass * {FINE_SCALE!r}D) AS BIGINT)"),
    ("within_ppm", "a DOUBLE, b DOUBLE, ppm DOUBLE", "abs(a - b) < a * ppm / 1e6D"),
    ("in_isolation_window", "mz DOUBLE, target DOUBLE, lower_by DOUBLE, upper_by DOUBLE", "mz >= target - lower_by AND mz < target + upper_by"),
    ("logistic", "score DOUBLE", "1.0D / (1.0D + exp(-score))"),
)


class Digest:
    """digest(sequence, residues, missed): fully enzymatic peptides, 0-based start."""

    def eval(self, sequence: str, residues: str, missed: int) -> Iterator[tuple]:
        if not sequence:
            return
        cuts = sorted({0, len(sequence), *(i + 1 for i, r in enumerate(sequence) if r in residues)})
        for i in range(len(cuts) - 1):
            for j in range(i + 1, min(len(cuts), i + 2 + missed)):
                yield sequence[cuts[i] : cuts[j]], cuts[i], j - i - 1


class Fragments:
    """fragments(sequence): masses of the b and y fragments of every cleavage."""

    def eval(self, sequence: str) -> Iterator[tuple]:
        masses = [RESIDUE_MASS.get(r, 0.0) for r in sequence or ""]
        total, prefix = sum(masses), 0.0
        for i, m in enumerate(masses[:-1], 1):
            prefix += m
            yield "b", i, prefix
            yield "y", len(masses) - i, total - prefix + WATER


def register(spark: SparkSession) -> list[str]:
    """Registers everything in ``spark`` and returns the names."""
    for name, arguments, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURN {body}")
    python = {"envelope_of_mass": numeric.envelope_of_mass, "hypergeometric_p": numeric.hypergeometric_udf, "rank_sum_p": numeric.rank_sum_udf, "poisson_p": numeric.poisson_udf}
    for name, f in python.items():
        spark.udf.register(name, f)
    tables = {"digest": udtf(Digest, returnType="peptide string, start int, missed int"), "fragments": udtf(Fragments, returnType="series string, length int, mass double")}
    for name, f in tables.items():
        spark.udtf.register(name, f)
    return [*(e[0] for e in EXPRESSIONS), *python, *tables]

