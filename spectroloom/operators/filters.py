"""Filters of scans, features, matches and sequences; all reach the files' statistics where columns are plain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.functions.mass import ATOM_MASS

#: Fixed value: what decoys' names begin with.
DECOY = "XXX"

# Common modifications and the atoms they add (13C and 15N are heavy isotopes).
MODIFICATIONS = {
    "Acetyl": {"C": 2, "H": 2, "O": 1}, "Carbamidomethyl": {"C": 2, "H": 3, "N": 1, "O": 1}, "Carbamyl": {"C": 1, "H": 1, "N": 1, "O": 1}, "Carboxymethyl": {"C": 2, "H": 2, "O": 2}, "Deamidated": {"H": -1, "N": -1, "O": 1},
    "NIPCAM": {"C": 5, "H": 9, "N": 1, "O": 1}, "Phospho": {"H": 1, "O": 3, "P": 1}, "Pyro-carbamidomethyl": {"H": -3, "N": -1}, "Glu->pyro-Glu": {"H": -2, "O": -1}, "Gln->pyro-Glu": {"H": -3, "N": -1}, "Methyl": {"C": 1, "H": 2},
    "Oxidation": {"O": 1}, "TriOxidation": {"O": 3}, "Dimethyl": {"C": 2, "H": 4}, "Trimethyl": {"C": 3, "H": 6}, "Glutathione": {"C": 10, "H": 15, "N": 3, "O": 6, "S": 1}, "Cysteinyl": {"C": 3, "H": 5, "N": 1, "O": 2, "S": 1}, "Dehydro": {"H": -1},
    "iTRAQ4plex": {"C": 4, "H": 12, "N": 1, "O": 1, "13C": 3, "15N": 1}, "TMT6plex": {"C": 8, "H": 20, "N": 1, "O": 2, "13C": 4, "15N": 1}, "Nethylmaleimide": {"C": 6, "H": 7, "N": 1, "O": 2}, "Nitrosyl": {"H": -1, "N": 1, "O": 1},
    "Thr->Ala": {"C": -1, "H": -2, "O": -1}, "Dethiomethyl": {"C": -1, "H": -4, "S": -1}, "Delta:H(2)C(2)": {"C": 2, "H": 2}, "Ser->Xle": {"C": 3, "H": 6, "O": -1}, "Ser->Asn": {"C": 1, "H": 1, "N": 1}, "Ser->Asp": {"C": 1, "O": 1},
    "Label:13C(6)15N(2)": {"C": -6, "N": -2, "13C": 6, "15N": 2}, "Label:13C(6)15N(4)": {"C": -6, "N": -4, "13C": 6, "15N": 4}, "TEV-FP2": {"C": 26, "H": 48, "N": 7, "O": 9, "P": 1},
}


def of_level(scans: DataFrame, level: int, column: str = "ms_level") -> DataFrame:
    return scans.where(F.col(column) == level)


def in_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows with low <= column <= high; an absent limit is open."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def of_length(df: DataFrame, sequence: str, least: int, most: int) -> DataFrame:
    return df.where(F.length(sequence).between(least, most))


def without_decoys(df: DataFrame, protein: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(protein), F.lit("")).startswith(DECOY))


def peptides_within(df: DataFrame, peptide: str, protein: str, q_value: str, most: float) -> DataFrame:
    """Distinct peptides of targets with q-values up to ``most``."""
    return without_decoys(df, protein).where(F.col(q_value) <= most).select(peptide).distinct()


def above(df: DataFrame, score: str, least: float, strict: bool = False) -> DataFrame:
    return df.where(F.col(score) > least if strict else F.col(score) >= least)


def modification_table(spark: SparkSession) -> DataFrame:
    """(name, mass) of the common modifications: a constant."""
    return spark.createDataFrame([(n, sum(k * ATOM_MASS[a] for a, k in atoms.items())) for n, atoms in sorted(MODIFICATIONS.items())], "name string, mass double")


def named_shifts(df: DataFrame, shift: str, da: float = 0.01) -> DataFrame:
    """``df`` with the ``modification`` nearest to a mass shift, null if none is within ``da``."""
    table = modification_table(df.sparkSession)
    nearest = F.broadcast(table.agg(F.collect_list(F.struct("mass", "name")).alias("_all")))
    pick = F.array_min(F.transform(F.filter("_all", lambda m: F.abs(m["mass"] - F.col(shift)) <= da), lambda m: F.struct(F.abs(m["mass"] - F.col(shift)).alias("gap"), m["name"].alias("name"))))
    # one row is joined: the constant table as an array
    return df.join(nearest).withColumn("modification", pick["name"]).drop("_all")
