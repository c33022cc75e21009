"""Spectra: mzML, MGF and msalign in, Parquet runs in and out.

A run is a folder of ``spectra`` (one row a scan, peaks as arrays) and ``peaks`` (one row a peak,
in ranges of m/z and sorted within), which replaces binary caches with their own indexes.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1
#: Files with parameter groups (some KB each) up to which the groups are broadcast.
GROUP_FILES = 5000
SPECTRUM_SCHEMA = (
    "scan_num int, native_id string, ms_level int, elution_time double, tic double, mz array<double>, intensity array<double>, "
    "isolation struct<mono_mz:double,charge:int,target_mz:double,lower:double,upper:double>, activation string"
)
# Accessions of the terms that are read.
TERMS = {
    "MS:1000511": "ms_level", "MS:1000016": "elution_time", "MS:1000285": "tic", "MS:1000827": "target_mz", "MS:1000828": "lower", "MS:1000829": "upper", "MS:1000744": "mono_mz", "MS:1000041": "charge",
}
ACTIVATIONS = {"MS:1000133": "CID", "MS:1000422": "HCD", "MS:1000598": "ETD", "MS:1000250": "ECD", "MS:1000599": "PQD", "MS:1003247": "UVPD", "MS:1003246": "UVPD"}
NATIVE_SCAN = re.compile(r"(?:^|\s)(?:scan|index|spectrum|scanId)=(\d+)")


def decode_array(node: ElementTree.Element) -> tuple[str, np.ndarray]:
    """A binary array: which one it is, and its values."""
    terms = {c.get("accession") for c in node.iter("cvParam")}
    raw = base64.b64decode((node.findtext("binary") or "").strip())
    if "MS:1000574" in terms:
        raw = zlib.decompress(raw) if raw else b""
    kind = "<f4" if "MS:1000521" in terms else "<i8" if "MS:1000522" in terms else "<i4" if "MS:1000519" in terms else "<f8"
    name = "mz" if "MS:1000514" in terms else "intensity" if "MS:1000515" in terms else "other"
    return name, np.frombuffer(raw, kind).astype(np.float64)


def parameter_groups(fragment: str | None) -> dict[str, list[ElementTree.Element]]:
    """The parameters of each group of a file's list of parameter groups, by the group's id; none without a list."""
    if not fragment:
        return {}
    return {g.get("id"): list(g) for g in ElementTree.fromstring(fragment).iter("referenceableParamGroup")}


def parse_spectrum(fragment: str, peaks: bool = True, groups: dict[str, list[ElementTree.Element]] | None = None) -> dict | None:
    """A spectrum element cut from an mzML file as a row; None if there is none.

    References to parameter groups stand for the parameters of ``groups``; unknown ones for nothing.
    """
    start = fragment.find("<spectrum ")
    if start < 0:
        return None
    root = ElementTree.fromstring(re.sub(r"\sxmlns(:\w+)?=\"[^\"]*\"", "", fragment[start:]) + "</spectrum>")
    for node in list(root.iter()):
        for ref in node.findall("referenceableParamGroupRef"):
            node.extend((groups or {}).get(ref.get("ref"), []))
    native = root.get("id") or ""
    found = NATIVE_SCAN.search(native)
    row = {"scan_num": int(found[1]) if found else int(root.get("index", -1)) + 1, "native_id": native, "ms_level": None, "elution_time": None, "tic": None, "mz": [], "intensity": [], "isolation": None, "activation": None}
    precursor: dict = {}
    for term in root.iter("cvParam"):
        name, value = TERMS.get(term.get("accession")), term.get("value")
        if name == "ms_level":
            row["ms_level"] = int(value)
        elif name == "elution_time":
            row[name] = float(value) / (60 if term.get("unitName") == "second" or term.get("unitAccession") == "UO:0000010" else 1)
        elif name == "tic":
            row[name] = float(value)
        elif name == "charge":
            precursor.setdefault(name, int(value))
        elif name:
            precursor.setdefault(name, float(value))
        elif term.get("accession") in ACTIVATIONS:
            row["activation"] = row["activation"] or ACTIVATIONS[term.get("accession")]
    if precursor:
        row["isolation"] = {k: precursor.get(k) for k in ("mono_mz", "charge", "target_mz", "lower", "upper")}
    if peaks:
        for node in root.iter("binaryDataArray"):
            name, values = decode_array(node)
            if name != "other":
                row[name] = values.tolist()
    return row


def read_mzml(spark: SparkSession, path: str, peaks: bool = True) -> DataFrame:
    """mzML 1.0 and 1.1, plain or gzip: files are cut at the ends of spectra and parsed in parallel.

    ``peaks=False`` leaves the arrays undecoded. The file's name is in ``run``. Parameter groups stand at the head of a file:
    they are looked for first, by a scan without any parsing, and joined to the file's spectra (by broadcast where at most
    ``GROUP_FILES`` files have some). Groups of one file are unknown in others.
    """
    cut = spark.read.option("lineSep", "</spectrum>").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    found = cut.where(F.col("value").contains("<referenceableParamGroupList")).select("file", F.regexp_extract("value", r"(?s)(<referenceableParamGroupList.*?</referenceableParamGroupList>)", 1).alias("groups"))
    files = found.count()
    if files:
        # a second list of a file, which the format does not allow, would repeat its spectra
        lists = found.groupBy("file").agg(F.first("groups").alias("groups"))
        cut = cut.join(F.broadcast(lists) if files <= GROUP_FILES else lists, "file", "left")
    else:
        cut = cut.withColumn("groups", F.lit(None).cast("string"))
    cut = cut.select("value", F.element_at(F.split("file", "/"), -1).alias("run"), "groups")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SPECTRUM_SCHEMA.split(", ")]
        text, groups = None, {}
        for frame in frames:
            rows = []
            for value, name, listed in zip(frame["value"], frame["run"], frame["groups"], strict=True):
                if listed != text:
                    text, groups = listed, parameter_groups(listed)
                if row := parse_spectrum(value, peaks, groups):
                    rows.append(row | {"run": name})
            yield pd.DataFrame(rows, columns=[*names, "run"])

    return cut.where(F.col("value").contains("<spectrum ")).mapInPandas(run, SPECTRUM_SCHEMA + ", run string")


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of an MGF file: title, scan, charge, precursor m/z, peptide (SEQ=) and peaks."""
    blocks = spark.read.option("lineSep", "END IONS").text(path).select(F.regexp_replace("value", "\r", "").alias("b")).where(F.col("b").contains("BEGIN IONS"))
    field = lambda name: F.regexp_extract("b", rf"(?m)^{name}=(.*)$", 1)
    number = r"(?m)^(\d+\.?\d*(?:[eE][+-]?\d+)?)[ \t]+(\d+\.?\d*(?:[eE][+-]?\d+)?)"
    peaks = lambda k: F.transform(F.regexp_extract_all("b", F.lit(number), F.lit(k)), lambda x: x.cast("double"))
    return blocks.select(
        field("TITLE").alias("title"), field("SCANS").try_cast("int").alias("scan_num"), F.regexp_extract(field("CHARGE"), r"(\d+)", 1).try_cast("int").alias("charge"),
        F.regexp_extract(field("PEPMASS"), r"^([0-9.]+)", 1).try_cast("double").alias("precursor_mz"), F.nullif(field("SEQ"), F.lit("")).alias("sequence"), peaks(1).alias("mz"), peaks(2).alias("intensity"),
    )


def read_msalign(spark: SparkSession, path: str) -> DataFrame:
    """Deconvoluted peaks of an msalign file: (scan_num, mass, intensity, charge), one row a peak."""
    blocks = spark.read.option("lineSep", "BEGIN IONS").text(path).select(F.regexp_replace("value", "\r", "").alias("b"))
    scan = F.regexp_extract("b", r"(?m)^SCANS=(\d+)", 1).try_cast("int")
    lines = F.regexp_extract_all("b", F.lit(r"(?m)^([0-9.eE+-]+[ \t]+[0-9.eE+-]+[ \t]+\d+)[ \t]*$"), 1)
    rows = blocks.select(scan.alias("scan_num"), F.explode(lines).alias("line")).where(F.col("scan_num").isNotNull())
    part = lambda k: F.split("line", r"[ \t]+")[k]
    return rows.select("scan_num", part(0).cast("double").alias("mass"), part(1).cast("double").alias("intensity"), part(2).cast("int").alias("charge"))


def exploded_peaks(spectra: DataFrame, *keys: str) -> DataFrame:
    """One row a peak: keys (scan_num, ms_level by default), mz, intensity."""
    keys = keys or ("scan_num", "ms_level")
    return spectra.select(*keys, F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select(*keys, "p.mz", "p.intensity")


def write_run(spectra: DataFrame, path: str, mode: str = "ignore", partitions: int | None = None) -> None:
    """Writes a run's folder; an existing one stays with mode ``ignore``, as a cache."""
    spectra = spectra.withColumn("format_version", F.lit(FORMAT_VERSION))
    spectra.sortWithinPartitions("scan_num").write.mode(mode).parquet(f"{path}/spectra")
    peaks = exploded_peaks(spectra)
    ranged = peaks.repartitionByRange(partitions, "mz") if partitions else peaks.repartitionByRange("mz")
    ranged.sortWithinPartitions("mz").write.mode(mode).partitionBy("ms_level").parquet(f"{path}/peaks")


def read_run(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The spectra of a run's folder; scan limits reach the files' statistics."""
    df = spark.read.parquet(f"{path}/spectra")
    if df.limit(1).select(F.col("format_version")).where(F.col("format_version") > FORMAT_VERSION).count():
        raise ValueError(f"{path} was written by a later version")
    if first is not None:
        df = df.where(F.col("scan_num") >= first)
    if last is not None:
        df = df.where(F.col("scan_num") <= last)
    return df


def read_run_peaks(spark: SparkSession, path: str, ms_level: int, low: float | None = None, high: float | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/peaks").where(F.col("ms_level") == ms_level)
    if low is not None:
        df = df.where(F.col("mz") >= low)
    return df if high is None else df.where(F.col("mz") <= high)
