"""Masses, tolerances and bins as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants and bin scales.
PROTON = 1.00727649
C13_MINUS_C12 = 1.00335483
NOMINAL_SCALE = 0.9995
FINE_SCALE = 274.335215
ATOM_MASS = {"C": 12.0, "H": 1.007825035, "N": 14.003074, "O": 15.99491463, "S": 31.9720707, "P": 30.973762, "13C": 13.00335483, "15N": 15.000108898}

# Atoms C, H, N, O, S of each amino-acid residue.
RESIDUES = {
    "G": (2, 3, 1, 1, 0), "A": (3, 5, 1, 1, 0), "S": (3, 5, 1, 2, 0), "P": (5, 7, 1, 1, 0), "V": (5, 9, 1, 1, 0), "T": (4, 7, 1, 2, 0), "C": (3, 5, 1, 1, 1), "L": (6, 11, 1, 1, 0),
    "I": (6, 11, 1, 1, 0), "N": (4, 6, 2, 2, 0), "D": (4, 5, 1, 3, 0), "Q": (5, 8, 2, 2, 0), "K": (6, 12, 2, 1, 0), "E": (5, 7, 1, 3, 0), "M": (5, 9, 1, 1, 1), "H": (6, 7, 3, 1, 0),
    "F": (9, 9, 1, 1, 0), "R": (6, 12, 4, 1, 0), "Y": (9, 9, 1, 2, 0), "W": (11, 10, 2, 1, 0),
}

#: Monoisotopic residue masses, from the atoms.
RESIDUE_MASS = {r: sum(n * ATOM_MASS[a] for n, a in zip(atoms, "CHNOS", strict=True)) for r, atoms in RESIDUES.items()}
WATER = 2 * ATOM_MASS["H"] + ATOM_MASS["O"]

# Mass offsets (from the sum of residues) of the fragment series, and which end they hold.
ION_SERIES = {
    "a": ("prefix", -(ATOM_MASS["C"] + ATOM_MASS["O"])),
    "b": ("prefix", 0.0),
    "c": ("prefix", 3 * ATOM_MASS["H"] + ATOM_MASS["N"]),
    "x": ("suffix", ATOM_MASS["C"] + 2 * ATOM_MASS["O"]),
    "y": ("suffix", WATER),
    "z": ("suffix", ATOM_MASS["O"] - ATOM_MASS["N"] - ATOM_MASS["H"]),
}
NEUTRAL_LOSS = {"": 0.0, "-H2O": WATER, "-NH3": ATOM_MASS["N"] + 3 * ATOM_MASS["H"]}


def within_ppm(a: Column, b: Column, ppm) -> Column:
    """Strictly closer than ``ppm`` millionths of ``a``."""
    return F.abs(a - b) < a * ppm / 1e6


def within_da(a: Column, b: Column, da) -> Column:
    return F.abs(a - b) < da


def tolerance_value(text: Column) -> Column:
    """The number of a tolerance such as 10ppm, 0.5Da or 0.2th; null if there is none."""
    return F.regexp_extract(text, r"^\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")


def tolerance_unit(text: Column) -> Column:
    unit = F.lower(F.regexp_extract(text, r"([A-Za-z]+)\s*$", 1))
    return F.when(unit == "ppm", "ppm").when(unit.isin("da", "dalton"), "da").when(unit.isin("th", "mz"), "mz")


def isotope_mz(mass: Column, charge: Column, isotope) -> Column:
    return (mass + isotope * F.lit(C13_MINUS_C12)) / charge + F.lit(PROTON)


def mono_mass(mz: Column, charge: Column, isotope) -> Column:
    return (mz - F.lit(PROTON)) * charge - isotope * F.lit(C13_MINUS_C12)


def in_isolation_window(mz: Column, target: Column, lower: Column, upper: Column) -> Column:
    """Half-open: target - lower <= mz < target + upper."""
    return (mz >= target - lower) & (mz < target + upper)


def nominal_bin(mass: Column) -> Column:
    """Rounds half to even."""
    return F.bround(mass * F.lit(NOMINAL_SCALE)).cast("long")


def fine_bin(mass: Column) -> Column:
    return F.bround(mass * F.lit(FINE_SCALE)).cast("long")


def float_bits_bin(mz: Column, bits: int = 27) -> Column:
    """The leading ``bits`` bits of a positive double's representation: bins of equal ppm width."""
    steps = 1 << (bits - 12)
    e = F.floor(F.log2(mz))
    # the logarithm can round up to the next power of two
    e = F.when(F.pow(F.lit(2.0), e) > mz, e - 1).when(F.pow(F.lit(2.0), e + 1) <= mz, e + 1).otherwise(e)
    return ((1023 + e) * steps + F.floor((mz / F.pow(F.lit(2.0), e) - 1) * steps)).cast("long")


def ppm_of_bits(bits: int) -> float:
    return 16.0 * 2 ** (27 - bits)


def bits_for_ppm(ppm: float) -> int:
    """27 bits for 16 ppm, one more for each halving."""
    return int(round(27 - math.log2(ppm / 16)))


def charge_span(mass: Column, low_mz, high_mz) -> Column:
    """The charges at which a mass lies between two m/z, ascending; null if there are none."""
    least = F.ceil(mass / (F.lit(high_mz) - PROTON)).cast("long")
    most = F.floor(mass / (F.lit(low_mz) - PROTON)).cast("long")
    least = F.greatest(least, F.lit(1).cast("long"))
    return F.when(least <= most, F.sequence(least, most))


def logistic(score: Column, offset: float = 0.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(score + offset)))


def residue_mass(sequence: Column) -> Column:
    """Sum of residue masses; letters that are no residue weigh nothing."""
    table = F.create_map(*[x for r, m in RESIDUE_MASS.items() for x in (F.lit(r), F.lit(m))])
    return F.aggregate(F.filter(F.split(sequence, ""), lambda r: r != ""), F.lit(0.0), lambda total, r: total + F.coalesce(F.element_at(table, r), F.lit(0.0)))


def residue_atoms(sequence: Column) -> Column:
    """Atoms C, H, N, O, S of a sequence's residues, as a struct of longs."""
    out = []
    for k, atom in enumerate("CHNOS"):
        total = sum((F.length(sequence) - F.length(F.replace(sequence, F.lit(r), F.lit("")))) * atoms[k] for r, atoms in RESIDUES.items() if atoms[k])
        out.append(F.coalesce(total, F.lit(0)).cast("long").alias(atom))
    return F.struct(*out)


def atoms_mass(atoms: Column) -> Column:
    return sum(atoms[a] * F.lit(ATOM_MASS[a]) for a in "CHNOS")


def averagine_atoms(mass: Column) -> Column:
    """Atoms of an average protein of this mass, rounded half to even."""
    # Atoms of the average residue.
    unit = {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}
    weight = sum(n * ATOM_MASS[a] for a, n in unit.items())
    return F.struct(*[F.bround(mass / weight * n).cast("long").alias(a) for a, n in unit.items()])
