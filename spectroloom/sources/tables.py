"""Delimited tables: features, search results, deisotoped peaks, data sets, tags, crosstabs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of feature tables.
FEATURE_SCHEMA = (
    "FeatureID int, MinScan int, MaxScan int, MinCharge int, MaxCharge int, MonoMass double, RepScan int, RepCharge int, RepMz double, Abundance double, ApexScanNum int, ApexIntensity double, "
    "MinElutionTime double, MaxElutionTime double, ElutionLength double, Envelope string, LikelihoodRatio double"
)
FEATURE_EXTENDED = (
    "BestEvenCharge int, BestOddCharge int, CorrEvenCharge double, CorrOddCharge double, IntensityEvenCharge double, IntensityOddCharge double, SummedCorrEvenCharge double, SummedCorrOddCharge double, "
    "SummedIntensityEvenCharge double, SummedIntensityOddCharge double, XicCorrBetCharges1 double, XicCorrBetCharges2 double, AbundanceRatioEvenCharge double, AbundanceRatioOddCharge double"
)
# Columns of search results, and other names that files give them.
RESULT_SCHEMA = (
    "Scan int, Pre string, Sequence string, Post string, Modifications string, Composition string, ProteinName string, ProteinDesc string, ProteinLength int, Start int, End int, Charge int, "
    "MostAbundantIsotopeMz double, Mass double, Ms1Features int, NumMatchedFragments int, Probability double, SpecEValue double, EValue double"
)
RESULT_TDA = "QValue double, PepQValue double"
RESULT_ALIASES = {"Peptide": "Sequence", "#Peptide": "Sequence", "Protein": "ProteinName", "#MatchedFragments": "NumMatchedFragments", "Score": "NumMatchedFragments"}


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in schema.split(", ")]


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", comment: str | None = None) -> DataFrame:
    """All columns as text, by the header's names.

    Rows longer than the header are left out (``rejected_lines`` gives them), shorter ones end with nulls; empty fields are null.
    Nothing is quoted. Of several files, each repeats the header.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).where(F.col("line") != "")
    if comment:
        lines = lines.where(~F.col("line").startswith(comment))
    first = lines.first()
    names = first[0].split(sep) if first else []
    if not names:
        return spark.createDataFrame([], "line string").drop("line")
    cells = lines.where(F.col("line") != first[0]).select(F.split("line", re.escape(sep), -1).alias("c")).where(F.size("c") <= len(names))
    return cells.select(*[F.nullif(F.get("c", k), F.lit("")).alias(n) for k, n in enumerate(names)])


def rejected_lines(spark: SparkSession, path: str, sep: str = "\t", comment: str | None = None) -> DataFrame:
    """(line): what ``read_delimited`` leaves out of a file, lines with more fields than the header."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).where(F.col("line") != "")
    if comment:
        lines = lines.where(~F.col("line").startswith(comment))
    first = lines.first()
    return lines.where(F.size(F.split("line", re.escape(sep), -1)) > (len(first[0].split(sep)) if first else 0))


def _typed(raw: DataFrame, schema: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """The columns of ``schema`` by name or alias, cast; absent ones are null."""
    named = {(aliases or {}).get(c, c): c for c in raw.columns}
    quoted = lambda c: F.col(f"`{c}`")
    return raw.select(*[(quoted(named[n]).try_cast(k) if n in named else F.lit(None).cast(k)).alias(n) for n, k in _columns(schema)])


def parse_envelope(s: Column) -> Column:
    """``index,ratio;index,ratio`` as an array of structs."""
    each = F.filter(F.split(F.coalesce(s, F.lit("")), ";"), lambda p: p.contains(","))
    return F.transform(each, lambda p: F.struct(F.split(p, ",")[0].cast("int").alias("index"), F.split(p, ",")[1].cast("double").alias("ratio")))


def format_envelope(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda e: F.concat(e["index"].cast("string"), F.lit(","), F.format_string("%.3f", e["ratio"]))), ";")


def read_features(spark: SparkSession, path: str, extended: bool = False) -> DataFrame:
    """Feature tables, with ``isotopes`` parsed from the envelope text."""
    typed = _typed(read_delimited(spark, path), FEATURE_SCHEMA + (", " + FEATURE_EXTENDED if extended else ""))
    return typed.withColumn("isotopes", parse_envelope(F.col("Envelope")))


def _in_order(df: DataFrame, one_file: bool, *order: str) -> DataFrame:
    """One file in order, or as many as the session's shuffle makes, each in order and behind the one before."""
    parts = 1 if one_file else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.coalesce(1) if one_file else df.repartitionByRange(parts, *order)).sortWithinPartitions(*order)


def write_features(features: DataFrame, path: str, extended: bool = False, one_file: bool = True) -> None:
    """Feature tables with the fixed number formats of their readers, in order of FeatureID."""
    fixed = {"MonoMass": "%.4f", "RepMz": "%.4f", "Abundance": "%.4f", "ApexIntensity": "%.4f", "MinElutionTime": "%.3f", "MaxElutionTime": "%.3f", "ElutionLength": "%.3f", "LikelihoodRatio": "%.4f"}
    names = [n for n, _ in _columns(FEATURE_SCHEMA + (", " + FEATURE_EXTENDED if extended else ""))]
    out = features.select(*[F.format_string(fixed[n], n).alias(n) if n in fixed else F.col(n) for n in names])
    _in_order(out, one_file, "FeatureID").write.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def read_results(spark: SparkSession, path: str, comment: bool = False) -> DataFrame:
    """Search results; QValue and PepQValue are there if the file has them. Peptides ``A.SEQ.K`` are divided."""
    raw = read_delimited(spark, path)
    with_fdr = "QValue" in raw.columns
    typed = _typed(raw, RESULT_SCHEMA + (", " + RESULT_TDA if with_fdr else ""), RESULT_ALIASES)
    return typed.where(F.col("Scan").isNotNull())


def with_tiny_floor(results: DataFrame, least: float = 9.99e-308) -> DataFrame:
    present = [c for c in ("SpecEValue", "EValue") if c in results.columns]
    return results.withColumns({c: F.greatest(F.lit(least), F.col(c)) for c in present})


def write_results(results: DataFrame, path: str, one_file: bool = True) -> None:
    """Search results in order of scan; very small values are written as the least that readers take."""
    _in_order(with_tiny_floor(results), one_file, "Scan", "EValue").write.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def read_isotope_peaks(spark: SparkSession, path: str, most_fit: float = 1.0) -> DataFrame:
    """Deisotoped peaks (csv): rows with fit above ``most_fit`` or charge 1 and less go; an absent fit passes."""
    typed = _typed(read_delimited(spark, path, ","), "scan_num int, charge int, monoisotopic_mw double, fit double")
    return typed.where((F.col("fit").isNull() | ~(F.col("fit") > most_fit)) & (F.col("charge") > 1))


def write_envelope_rows(envelopes: DataFrame, path: str, one_file: bool = True) -> None:
    names = ["scan_num", "charge", "abundance", "mz", "fit", "monoisotopic_mw", "FeatureID"]
    _in_order(envelopes.select(*names), one_file, "FeatureID", "scan_num").write.option("header", True).csv(path)


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """Label, RawFilePath, FeatureFilePath and, where given, IdFilePath; rows with fewer than three go.

    An empty label becomes Dataset_n by the row's place. A list of files is small: it is read in one piece.
    """
    lines = spark.read.text(path).coalesce(1).withColumn("_n", F.monotonically_increasing_id()).select("_n", F.split(F.regexp_replace("value", "\r", ""), "\t").alias("f"))
    rows = lines.where((F.size("f") >= 3) & ~F.lower(F.col("f")[0]).isin("label"))
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_n"))
    return rows.select(
        F.coalesce(F.nullif(F.trim(F.col("f")[0]), F.lit("")), F.concat(F.lit("Dataset_"), at.cast("string"))).alias("Label"), F.trim(F.col("f")[1]).alias("RawFilePath"),
        F.trim(F.col("f")[2]).alias("FeatureFilePath"), F.nullif(F.trim(F.get("f", 3)), F.lit("")).alias("IdFilePath"),
    )


# Which columns of three tools' tables hold what.
MATCH_COLUMNS = {
    "own": {"Scan": "scan", "Sequence": "sequence", "Modifications": "modifications", "Mass": "mass", "Charge": "charge", "ProteinName": "protein", "ProteinDesc": "protein_desc", "#MatchedFragments": "score", "Start": "start", "End": "end", "QValue": "q_value"},
    "alignment": {"Scan(s)": "scan", "Peptide": "sequence", "Precursor_mass": "mass", "Charge": "charge", "Protein_name": "protein", "First_residue": "start", "Last_residue": "end", "#matched_fragment_ions": "score", "E-value": "e_value", "FDR": "q_value"},
    "generating_function": {"Scan": "scan", "ScanNum": "scan", "Peptide": "sequence", "PrecursorMZ": "mz", "Precursor": "mz", "Charge": "charge", "Protein": "protein", "MSGFScore": "score", "QValue": "q_value"},
}
MATCH_SCHEMA = "scan int, sequence string, modifications string, mass double, mz double, charge int, protein string, protein_desc string, score double, start int, end int, e_value double, q_value double"


def tool_of(columns: list[str]) -> str:
    if "Precursor_mass" in columns or "#matched_fragment_ions" in columns:
        return "alignment"
    if "MSGFScore" in columns:
        return "generating_function"
    return "own"


def read_matches(spark: SparkSession, path: str, tool: str | None = None, most_q: float = 0.01, most_rows: int | None = None) -> DataFrame:
    """Identifications of one of three tools under common names, q-values up to ``most_q``, decoys left out."""
    raw = read_delimited(spark, path)
    tool = tool or tool_of(raw.columns)
    typed = _typed(raw, MATCH_SCHEMA, MATCH_COLUMNS[tool])
    if tool == "generating_function":
        from spectroloom.functions.mass import mono_mass

        typed = typed.withColumn("mass", F.coalesce("mass", mono_mass(F.col("mz"), F.col("charge"), F.lit(0))))
    kept = typed.where((F.coalesce("q_value", F.lit(0.0)) <= most_q) & ~F.coalesce("protein", F.lit("")).startswith("XXX")).withColumn("tool", F.lit(tool))
    return kept if most_rows is None else kept.orderBy("q_value", "scan", "sequence").limit(most_rows)


def read_tags(spark: SparkSession, path: str, least_length: int = 5, most_per_scan: int | None = None) -> DataFrame:
    """Sequence tags of at least a length, the first ``most_per_scan`` of each scan by score then tag."""
    raw = read_delimited(spark, path)
    names = {c.lower(): c for c in raw.columns}
    pick = lambda n, kind: (F.col(f"`{names[n]}`").try_cast(kind) if n in names else F.lit(None).cast(kind)).alias(n)
    tags = raw.select(pick("scannum", "int"), pick("sequencetag", "string"), pick("isprefix", "int"), pick("flankingmass", "double"), pick("score", "double")).where(F.length("sequencetag") >= least_length)
    if most_per_scan is None:
        return tags
    w = Window.partitionBy("scannum").orderBy(F.col("score").desc_nulls_last(), "sequencetag", "flankingmass")
    return tags.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_per_scan).drop("_n")


def read_scan_list(spark: SparkSession, path: str) -> DataFrame:
    """Integers of a text file, however they are separated."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(\d+)"), 1)).alias("n")).select(F.col("n").cast("int").alias("scan_num")).distinct()


def write_crosstab(table: DataFrame, path: str, order: str, one_file: bool = True) -> None:
    """A tab-separated table in order; nested columns are not allowed."""
    _in_order(table, one_file, order).write.option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())
