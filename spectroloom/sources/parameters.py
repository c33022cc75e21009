"""Modification definitions, parameter files, identification reports and format dispatch."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.functions.text import parse_composition
from spectroloom.sources import fasta, spectra, tables

LOCATIONS = ("any", "n-term", "c-term", "prot-n-term", "prot-c-term")


def read_modifications(spark: SparkSession, path: str) -> DataFrame:
    """(name, composition, residue, is_fixed, location), a row for each residue of each definition; * is any residue."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace(F.regexp_replace("value", "\r", ""), "#.*$", "")).alias("line"))
    parts = lines.where((F.col("line") != "") & ~F.lower(F.col("line")).startswith("nummods")).select(F.split("line", r"\s*,\s*").alias("p")).where(F.size("p") >= 5)
    each = parts.select(
        F.trim(F.col("p")[4]).alias("name"), parse_composition(F.col("p")[0]).alias("composition"), F.explode(F.filter(F.split(F.col("p")[1], ""), lambda r: r != "")).alias("residue"),
        (F.lower(F.col("p")[2]) == "fix").alias("is_fixed"), F.lower(F.col("p")[3]).alias("location"),
    )
    return each.where(F.col("location").isin(*LOCATIONS))


def most_modifications(spark: SparkSession, path: str, default: int = 0) -> int:
    """The number behind NumMods=."""
    found = spark.read.text(path).where(F.lower(F.trim("value")).startswith("nummods")).select(F.regexp_extract("value", r"=\s*(\d+)", 1).try_cast("int")).first()
    return found[0] if found and found[0] is not None else default


@dataclass
class SearchParameters:
    """What a search takes; names in files are matched without case."""

    min_length: int = 21
    max_length: int = 500
    min_charge: int = 2
    max_charge: int = 50
    min_product_charge: int = 1
    max_product_charge: int = 20
    min_mass: float = 3000.0
    max_mass: float = 50000.0
    precursor_ppm: float = 10.0
    product_ppm: float = 10.0
    max_modifications: int = 4
    keep: int = 3
    report: int = 1
    cleavage: str = "single"
    tag_search: bool = True
    activation: str = "unknown"
    extra: dict = field(default_factory=dict)


# Names that parameter files use.
PARAMETER_NAMES = {
    "minlength": "min_length", "maxlength": "max_length", "mincharge": "min_charge", "maxcharge": "max_charge", "minfragcharge": "min_product_charge", "maxfragcharge": "max_product_charge",
    "minmass": "min_mass", "maxmass": "max_mass", "pmtolerance": "precursor_ppm", "fragtolerance": "product_ppm", "nummods": "max_modifications", "matchesperspectrumtokeep": "keep",
    "nummatchesperspectrumtokeep": "keep", "nummatchesperspectrum": "report", "matchesperspectrumtoreport": "report", "tagsearch": "tag_search", "activationmethod": "activation",
}


def parse_parameters(lines: list[str]) -> SearchParameters:
    """``key=value`` lines; what stands behind # or ; is a comment, unknown keys are kept in ``extra``."""
    out = SearchParameters()
    kinds = {f.name: type(getattr(out, f.name)) for f in fields(out)}
    for line in lines:
        plain = line.split("#")[0].split(";")[0].strip()
        if "=" not in plain:
            continue
        key, value = (x.strip() for x in plain.split("=", 1))
        name = PARAMETER_NAMES.get(key.lower().replace("_", ""), key.lower())
        if name not in kinds or name == "extra":
            out.extra[key] = value
        elif kinds[name] is bool:
            setattr(out, name, value.lower() in ("true", "1", "yes"))
        else:
            number = value.lower().removesuffix("ppm").removesuffix("da").strip()
            setattr(out, name, kinds[name](float(number)) if kinds[name] in (int, float) else value)
    return out


def format_parameters(options: SearchParameters) -> list[str]:
    """Lines that ``parse_parameters`` reads back."""
    names = {v: k for k, v in reversed(PARAMETER_NAMES.items())}
    known = [f"{names.get(f.name, f.name)}={getattr(options, f.name)}" for f in fields(options) if f.name != "extra"]
    return known + [f"{k}={v}" for k, v in options.extra.items()]


def read_parameters(spark: SparkSession, path: str) -> SearchParameters:
    return parse_parameters([r[0] for r in spark.read.text(path).collect()])


def identification_xml(results: DataFrame, run: str = "run") -> DataFrame:
    """Rows (part, key, value) whose values in order are an identification report in XML."""
    def attribute(c):
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    spark = results.sparkSession
    proteins = results.select("ProteinName", "ProteinDesc", "ProteinLength").dropDuplicates(["ProteinName"])
    peptides = results.select("Sequence", "Modifications").distinct()
    peptide_id = F.concat(F.lit("Pep_"), F.sha1(F.concat_ws("|", "Sequence", "Modifications")))
    head = spark.createDataFrame([(0, "", f'<?xml version="1.0" encoding="utf-8"?>\n<MzIdentML version="1.1.0">\n<Inputs><SpectraData id="SD_1" name={quoteattr(run)}/></Inputs>\n<SequenceCollection>'), (3, "", "</SequenceCollection>\n<SpectrumIdentificationList>"), (5, "", "</SpectrumIdentificationList>\n</MzIdentML>")], "part int, key string, value string")
    p = proteins.select(F.lit(1).alias("part"), F.col("ProteinName").alias("key"), F.concat(F.lit('<DBSequence id="'), attribute(F.col("ProteinName")), F.lit('" length="'), F.coalesce(F.col("ProteinLength").cast("string"), F.lit("")), F.lit('" description="'), F.coalesce(attribute(F.col("ProteinDesc")), F.lit("")), F.lit('"/>')).alias("value"))
    q = peptides.select(F.lit(2).alias("part"), peptide_id.alias("key"), F.concat(F.lit('<Peptide id="'), peptide_id, F.lit('"><PeptideSequence>'), F.col("Sequence"), F.lit("</PeptideSequence><Modification name=\""), F.coalesce(attribute(F.col("Modifications")), F.lit("")), F.lit('"/></Peptide>')).alias("value"))
    r = results.select(F.lit(4).alias("part"), F.lpad(F.col("Scan").cast("string"), 12, "0").alias("key"), F.concat(F.lit('<SpectrumIdentificationResult spectrumID="scan='), F.col("Scan").cast("string"), F.lit('"><SpectrumIdentificationItem peptide_ref="'), peptide_id, F.lit('" chargeState="'), F.col("Charge").cast("string"), F.lit('" calculatedMass="'), F.format_string("%.9f", "Mass"), F.lit('" dbSequence_ref="'), attribute(F.col("ProteinName")), F.lit('"><cvParam name="SpecEValue" value="'), F.col("SpecEValue").cast("string"), F.lit('"/><cvParam name="EValue" value="'), F.col("EValue").cast("string"), F.lit('"/></SpectrumIdentificationItem></SpectrumIdentificationResult>')).alias("value"))
    return head.unionByName(p).unionByName(q).unionByName(r)


def write_identification_xml(results: DataFrame, path: str, run: str = "run") -> None:
    """The report as one XML file."""
    identification_xml(results, run).repartition(1).sortWithinPartitions("part", "key", "value").select("value").write.text(path)


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Dispatch by extension."""
    name = path.lower().rstrip("/").removesuffix(".gz")
    for ends, reader in (((".mzml",), spectra.read_mzml), ((".mgf",), spectra.read_mgf), ((".msalign",), spectra.read_msalign), (fasta.EXTENSIONS, fasta.read_fasta), ((".ms1ft",), tables.read_features), (("_ictarget.tsv", "_icdecoy.tsv", "_ictda.tsv"), tables.read_results), (("_isos.csv",), tables.read_isotope_peaks), (("mods.txt",), read_modifications)):
        if name.endswith(tuple(ends)):
            return reader(spark, path, **options)
    if name.endswith((".raw", ".d", ".wiff")):
        raise ValueError(f"{path}: a vendor's format; convert it to mzML first")
    if name.endswith((".tsv", ".txt")):
        return tables.read_delimited(spark, path)
    return spectra.read_run(spark, path, **options)
