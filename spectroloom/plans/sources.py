"""Queries of files: the sample tables written in each format, read back by its reader, and held against the tables."""

import base64
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from spectroloom.operators import training
from spectroloom.operators.scratch import shared_folder
from spectroloom.plans.registry import query
from spectroloom.sources import fasta, parameters, spectra, tables


def _lines(df, value, path: str) -> str:
    """One text file a partition, in a new folder whose name ends in ``path``."""
    folder = f"{shared_folder(df.sparkSession)}/{path}"
    df.select(value.alias("value")).write.text(folder)
    return folder


def _spectra(t):
    """A spectrum for each order: its lines' prices and quantities, in order of line."""
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))))
    peaks = t("lineitem").groupBy("l_orderkey").agg(lines.alias("p"))
    o = t("orders").withColumn("ms_level", F.when(F.col("o_orderstatus") == "F", 2).otherwise(1))
    return o.join(peaks, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("int").alias("scan_num"), "ms_level", (F.col("o_orderkey") / 64).alias("elution_time"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"), "o_totalprice"
    )


def _mzml(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def array(values, kind: str) -> str:
        raw = base64.b64encode(struct.pack(f"<{len(values)}d", *values)).decode()
        return f'<binaryDataArray encodedLength="{len(raw)}"><cvParam accession="MS:1000523" name="64-bit float"/><cvParam accession="MS:1000576" name="no compression"/><cvParam accession="{kind}"/><binary>{raw}</binary></binaryDataArray>'

    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            precursor = f'<precursorList count="1"><precursor><isolationWindow><cvParam accession="MS:1000827" value="{r.o_totalprice!r}"/><cvParam accession="MS:1000828" value="1.5"/><cvParam accession="MS:1000829" value="1.5"/></isolationWindow><selectedIonList count="1"><selectedIon><cvParam accession="MS:1000744" value="{r.o_totalprice / 2!r}"/><cvParam accession="MS:1000041" value="2"/></selectedIon></selectedIonList><activation><cvParam accession="MS:1000422"/></activation></precursor></precursorList>' if r.ms_level == 2 else ""
            out.append(f'<spectrum index="{r.scan_num}" id="controllerType=0 controllerNumber=1 scan={r.scan_num}" defaultArrayLength="{len(r.mz)}"><cvParam accession="MS:1000511" value="{r.ms_level}"/><userParam name="note" value="x"/><scanList count="1"><scan><cvParam accession="MS:1000016" value="{r.elution_time!r}" unitName="minute"/></scan></scanList>{precursor}<binaryDataArrayList count="2">{array(r.mz, "MS:1000514")}{array(r.intensity, "MS:1000515")}</binaryDataArrayList></spectrum>')
        yield pd.DataFrame({"value": out})


SPECTRA = """s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS ms_level, o_orderkey / 64 AS elution_time, o_totalprice, l_extendedprice AS mz, l_quantity AS intensity FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


@query("mzml_scan", f"""WITH {SPECTRA} SELECT CAST(o_orderkey AS INT) AS scan_num, ms_level, elution_time, CASE WHEN ms_level = 2 THEN o_totalprice / 2 END AS mono_mz, CASE WHEN ms_level = 2 THEN 'HCD' END AS activation,
  count(*) AS n, round(sum(mz), 3) AS mz_sum, max(intensity) AS base_peak FROM s GROUP BY ALL""")
def mzml_scan(t):
    path = _lines(_spectra(t).mapInPandas(_mzml, "value string"), F.col("value"), "run.mzML")
    df = spectra.read_mzml(t("region").sparkSession, path)
    total = F.aggregate("mz", F.lit(0.0), lambda a, x: a + x)
    return df.select("scan_num", "ms_level", "elution_time", F.col("isolation.mono_mz").alias("mono_mz"), "activation", F.size("mz").cast("long").alias("n"), F.round(total, 3).alias("mz_sum"), F.array_max("intensity").alias("base_peak"))


@query("mzml_headers", f"""WITH {SPECTRA} SELECT DISTINCT CAST(o_orderkey AS INT) AS scan_num, ms_level, CASE WHEN ms_level = 2 THEN o_totalprice END AS target_mz, CASE WHEN ms_level = 2 THEN 1.5 END AS lower FROM s""")
def mzml_headers(t):
    path = _lines(_spectra(t).mapInPandas(_mzml, "value string"), F.col("value"), "run.mzML")
    return spectra.read_mzml(t("region").sparkSession, path, peaks=False).where(F.size("mz") == 0).select("scan_num", "ms_level", F.col("isolation.target_mz").alias("target_mz"), F.col("isolation.lower").alias("lower"))


def _run(t) -> str:
    path = shared_folder(t("region").sparkSession)
    spectra.write_run(_spectra(t), path)
    return path


@query("run_scan_range", f"""WITH {SPECTRA} SELECT CAST(o_orderkey AS INT) AS scan_num, count(*) AS n, max(mz) AS highest FROM s WHERE o_orderkey BETWEEN (SELECT max(o_orderkey) // 4 FROM orders) AND (SELECT max(o_orderkey) // 2 FROM orders) GROUP BY ALL""")
def run_scan_range(t):
    last = t("orders").agg(F.max("o_orderkey")).first()[0]
    return spectra.read_run(t("region").sparkSession, _run(t), last // 4, last // 2).select("scan_num", F.size("mz").cast("long").alias("n"), F.array_max("mz").alias("highest"))


@query("run_peak_range", f"""WITH {SPECTRA} SELECT CAST(o_orderkey AS INT) AS scan_num, mz, intensity FROM s WHERE ms_level = 2 AND mz BETWEEN 20000 AND 60000""")
def run_peak_range(t):
    return spectra.read_run_peaks(t("region").sparkSession, _run(t), 2, 20000, 60000).select("scan_num", "mz", "intensity")


@query("run_cache_stays", """SELECT count(*) AS first_write, count(*) AS after_second FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def run_cache_stays(t):
    path, spark = _run(t), t("region").sparkSession
    first = spectra.read_run(spark, path).agg(F.count("*").alias("first_write"))
    # an existing run is a cache: a second conversion leaves it as it is
    spectra.write_run(_spectra(t).where("ms_level = 1"), path)
    return first.join(F.broadcast(spectra.read_run(spark, path).agg(F.count("*").alias("after_second"))))


@query("fasta_scan", """SELECT 'P' || p_partkey AS name, p_brand AS description, upper(replace(p_name, ' ', '')) AS sequence FROM part""")
def fasta_scan(t):
    p = t("part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_brand").alias("description"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"))
    path = f"{shared_folder(p.sparkSession)}/x.fasta"
    fasta.write_fasta(p, path, 10)
    return parameters.read_any(p.sparkSession, path)


@query("fasta_decoys", """WITH p AS (SELECT 'P' || p_partkey AS name, upper(replace(p_name, ' ', '')) AS sequence FROM part) SELECT name, sequence, false AS is_decoy FROM p UNION ALL SELECT 'XXX_' || name, reverse(sequence), true FROM p""")
def fasta_decoys(t):
    p = t("part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"))
    return fasta.with_decoys(p).select("name", "sequence", "is_decoy")


@query("fasta_offsets", """SELECT name, CAST(coalesce(sum(length(sequence) + 1) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM (SELECT 'P' || p_partkey AS name, replace(p_name, ' ', '') AS sequence FROM part)""")
def fasta_offsets(t):
    p = t("part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.replace("p_name", F.lit(" "), F.lit("")).alias("sequence"))
    return fasta.with_offsets(p).select("name", "start_offset")


def _features(t):
    c = t("customer")
    text = lambda n, v: v.alias(n)
    return c.select(
        text("FeatureID", F.col("c_custkey").cast("int")), text("MinScan", F.col("c_nationkey").cast("int")), text("MaxScan", (F.col("c_nationkey") + 9).cast("int")), text("MinCharge", F.lit(2)), text("MaxCharge", F.lit(5)),
        text("MonoMass", F.col("c_acctbal") + 1000), text("RepScan", (F.col("c_nationkey") + 1).cast("int")), text("RepCharge", F.lit(3)), text("RepMz", F.col("c_acctbal")), text("Abundance", F.abs("c_acctbal")), text("ApexScanNum", F.lit(1)),
        text("ApexIntensity", F.lit(1.5)), text("MinElutionTime", F.col("c_nationkey") / 8), text("MaxElutionTime", F.col("c_nationkey") / 8 + 1), text("ElutionLength", F.lit(1.0)), text("Envelope", F.lit("0,0.500;1,1.000")), text("LikelihoodRatio", F.lit(0.25)),
    )


@query("feature_table_scan", """SELECT CAST(c_custkey AS INT) AS FeatureID, c_acctbal + 1000 AS MonoMass, abs(c_acctbal) AS Abundance, CAST(c_nationkey + 9 AS INT) AS MaxScan, c_nationkey / 8 AS MinElutionTime, 2 AS isotopes, 1.5 AS ratios FROM customer""")
def feature_table_scan(t):
    f = _features(t)
    path = f"{shared_folder(f.sparkSession)}/x.ms1ft"
    tables.write_features(f, path)
    got = parameters.read_any(f.sparkSession, path)
    total = F.aggregate("isotopes", F.lit(0.0), lambda a, e: a + e["ratio"])
    return got.select("FeatureID", F.round("MonoMass", 2).alias("MonoMass"), F.round("Abundance", 2).alias("Abundance"), "MaxScan", "MinElutionTime", F.size("isotopes").alias("isotopes"), total.alias("ratios"))


@query("feature_table_legacy", """SELECT CAST(c_custkey AS INT) AS FeatureID, c_acctbal AS MonoMass, CAST(NULL AS DOUBLE) AS LikelihoodRatio FROM customer""")
def feature_table_legacy(t):
    # older tables have fewer columns, in another order
    c = t("customer")
    path = f"{shared_folder(c.sparkSession)}/old.ms1ft"
    c.select(F.col("c_acctbal").alias("MonoMass"), F.col("c_custkey").alias("FeatureID")).write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_features(c.sparkSession, path).select("FeatureID", "MonoMass", "LikelihoodRatio")


@query("envelope_rows_sink", """SELECT l_orderkey AS scan_num, count(*) AS n, sum(l_quantity) AS abundance FROM lineitem GROUP BY 1""")
def envelope_rows_sink(t):
    e = t("lineitem").select(F.col("l_orderkey").alias("scan_num"), F.lit(2).alias("charge"), F.col("l_quantity").alias("abundance"), F.col("l_extendedprice").alias("mz"), F.lit(0.1).alias("fit"), F.col("l_extendedprice").alias("monoisotopic_mw"), F.col("l_partkey").alias("FeatureID"))
    path = shared_folder(e.sparkSession) + "/x.csv"
    tables.write_envelope_rows(e, path)
    back = tables.read_delimited(e.sparkSession, path, ",")
    return back.groupBy(F.col("scan_num").cast("long").alias("scan_num")).agg(F.count("*").alias("n"), F.sum(F.col("abundance").cast("double")).alias("abundance"))


@query("isos_scan", """SELECT CAST(l_orderkey AS INT) AS scan_num, CAST(l_linenumber AS INT) AS charge, l_extendedprice AS monoisotopic_mw FROM lineitem WHERE l_discount * 20 <= 1.0 AND l_linenumber > 1""")
def isos_scan(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("scan_num"), F.col("l_linenumber").alias("charge"), F.col("l_extendedprice").alias("monoisotopic_mw"), (F.col("l_discount") * 20).alias("fit"))
    path = shared_folder(li.sparkSession) + "/x_isos.csv"
    li.write.option("header", True).csv(path)
    return parameters.read_any(li.sparkSession, path).select("scan_num", "charge", "monoisotopic_mw")


def _results(t):
    p = t("part")
    return p.select(
        F.col("p_partkey").cast("int").alias("Scan"), F.lit("K").alias("Pre"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("Sequence"), F.lit("R").alias("Post"), F.lit("").alias("Modifications"), F.lit("C(1)").alias("Composition"), F.col("p_brand").alias("ProteinName"),
        F.col("p_type").alias("ProteinDesc"), F.lit(100).alias("ProteinLength"), F.lit(1).alias("Start"), F.lit(9).alias("End"), F.col("p_size").cast("int").alias("Charge"), F.lit(500.5).alias("MostAbundantIsotopeMz"), F.col("p_retailprice").alias("Mass"), F.lit(1).alias("Ms1Features"),
        F.col("p_size").cast("int").alias("NumMatchedFragments"), F.lit(0.5).alias("Probability"), F.when(F.col("p_size") == 1, 0.0).otherwise(F.col("p_size") / 64).alias("SpecEValue"), (F.col("p_size") / 8).alias("EValue"),
    )


@query("result_table_scan", """SELECT CAST(p_partkey AS INT) AS Scan, upper(replace(p_name, ' ', '')) AS Sequence, p_brand AS ProteinName, CAST(p_size AS INT) AS NumMatchedFragments, p_retailprice AS Mass, CASE WHEN p_size = 1 THEN 9.99e-308 ELSE p_size / 64 END AS SpecEValue, p_size / 8 AS EValue FROM part""")
def result_table_scan(t):
    r = _results(t)
    path = f"{shared_folder(r.sparkSession)}/x_IcTarget.tsv"
    tables.write_results(r, path)
    return parameters.read_any(r.sparkSession, path).select("Scan", "Sequence", "ProteinName", "NumMatchedFragments", "Mass", "SpecEValue", "EValue")


@query("result_probe", """SELECT true AS full_table, false AS empty_table""")
def result_probe(t):
    r = _results(t)
    paths = [f"{shared_folder(r.sparkSession)}/x_IcTda.tsv" for _ in range(2)]
    tables.write_results(r, paths[0])
    tables.write_results(r.where("Scan < 0"), paths[1])
    found = [tables.has_rows(tables.read_results(r.sparkSession, p)) for p in paths]
    return r.sparkSession.createDataFrame([tuple(found)], "full_table boolean, empty_table boolean")


@query("identification_report", """SELECT (SELECT count(DISTINCT p_brand) FROM part) AS proteins, (SELECT count(DISTINCT upper(replace(p_name, ' ', ''))) FROM part) AS peptides, (SELECT count(*) FROM part) AS results, (SELECT count(*) FROM part) AS items""")
def identification_report(t):
    r = _results(t)
    path = shared_folder(r.sparkSession) + "/x.mzid"
    parameters.write_identification_xml(r, path)
    text = r.sparkSession.read.text(path)
    one = lambda tag: F.sum(F.regexp_count("value", F.lit(f"<{tag} ")))
    return text.agg(one("DBSequence").alias("proteins"), one("Peptide").alias("peptides"), one("SpectrumIdentificationResult").alias("results"), one("SpectrumIdentificationItem").alias("items"))


@query("match_tables", """WITH p AS (SELECT *, p_size / 1000 AS q FROM part) SELECT 'own' AS tool, CAST(p_partkey AS INT) AS scan, p_name AS sequence, p_retailprice AS mass FROM p WHERE q <= 0.02
UNION ALL SELECT 'alignment', CAST(p_partkey AS INT), p_name, p_retailprice FROM p WHERE q <= 0.02
UNION ALL SELECT 'generating_function', CAST(p_partkey AS INT), p_name, round((p_retailprice - 1.00727649) * 2, 6) FROM p WHERE q <= 0.02""")
def match_tables(t):
    p = t("part").withColumn("q", F.col("p_size") / 1000)
    spark, out = p.sparkSession, None
    columns = {
        "own": {"Scan": "p_partkey", "Sequence": "p_name", "Mass": "p_retailprice", "ProteinName": "p_brand", "QValue": "q"},
        "alignment": {"Scan(s)": "p_partkey", "Peptide": "p_name", "Precursor_mass": "p_retailprice", "Protein_name": "p_brand", "FDR": "q"},
        "generating_function": {"Scan": "p_partkey", "Peptide": "p_name", "PrecursorMZ": "p_retailprice", "Charge": "2", "Protein": "p_brand", "MSGFScore": "p_size", "QValue": "q"},
    }
    for names in columns.values():
        path = shared_folder(spark) + "/matches.tsv"
        p.select(*[(F.lit(2) if c == "2" else F.col(c)).alias(n) for n, c in names.items()]).write.option("header", True).option("sep", "\t").csv(path)
        one = tables.read_matches(spark, path, most_q=0.02).select("tool", "scan", "sequence", F.round("mass", 6).alias("mass"))
        out = one if out is None else out.unionByName(one)
    return out


@query("tag_table_scan", """SELECT o_custkey AS scannum, o_orderpriority AS sequencetag, o_totalprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderpriority) AS r FROM orders WHERE length(o_orderpriority) >= 6) WHERE r <= 2""")
def tag_table_scan(t):
    o = t("orders").select(F.col("o_custkey").alias("ScanNum"), F.col("o_orderpriority").alias("SequenceTag"), F.lit(1).alias("IsPrefix"), F.lit(0.5).alias("FlankingMass"), F.col("o_totalprice").alias("Score"))
    path = shared_folder(o.sparkSession) + "/tags.tsv"
    o.write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_tags(o.sparkSession, path, 6, 2).select(F.col("scannum").cast("long").alias("scannum"), "sequencetag", "score")


@query("mgf_scan", f"""WITH {SPECTRA} SELECT CAST(o_orderkey AS INT) AS scan_num, 2 AS charge, o_totalprice AS precursor_mz, count(*) AS n, round(sum(mz), 3) AS mz_sum, max(intensity) AS base_peak FROM s GROUP BY ALL""")
def mgf_scan(t):
    peaks = F.array_join(F.transform(F.arrays_zip("mz", "intensity"), lambda p: F.concat(p["mz"].cast("decimal(12,2)").cast("string"), F.lit(" "), p["intensity"].cast("string"))), "\n")
    block = F.concat(F.lit("BEGIN IONS\nTITLE=x."), "scan_num", F.lit("\nSCANS="), "scan_num", F.lit("\nCHARGE=2+\nPEPMASS="), F.col("o_totalprice").cast("decimal(14,2)").cast("string"), F.lit("\n"), peaks, F.lit("\nEND IONS"))
    s = _spectra(t)
    df = parameters.read_any(s.sparkSession, _lines(s, block, "x.mgf"))
    return df.select("scan_num", "charge", "precursor_mz", F.size("mz").cast("long").alias("n"), F.round(F.aggregate("mz", F.lit(0.0), lambda a, x: a + x), 3).alias("mz_sum"), F.array_max("intensity").alias("base_peak"))


@query("msalign_scan", f"""WITH {SPECTRA} SELECT CAST(o_orderkey AS INT) AS scan_num, mz AS mass, intensity, 3 AS charge FROM s""")
def msalign_scan(t):
    peaks = F.array_join(F.transform(F.arrays_zip("mz", "intensity"), lambda p: F.concat(p["mz"].cast("decimal(12,2)").cast("string"), F.lit("\t"), p["intensity"].cast("string"), F.lit("\t3"))), "\n")
    block = F.concat(F.lit("BEGIN IONS\nSCANS="), "scan_num", F.lit("\n"), peaks, F.lit("\nEND IONS"))
    s = _spectra(t)
    return parameters.read_any(s.sparkSession, _lines(s, block, "x.msalign")).select("scan_num", "mass", "intensity", "charge")


@query("modification_file", """SELECT 'Mod' || p_partkey AS name, unnest(string_split(CASE WHEN p_size % 2 = 0 THEN 'STY' ELSE 'M' END, '')) AS residue, p_size % 3 = 0 AS is_fixed, p_size AS oxygens FROM part""")
def modification_file(t):
    p = t("part")
    line = F.concat(F.lit("O"), F.lit("("), F.col("p_size").cast("string"), F.lit("), "), F.when(F.col("p_size") % 2 == 0, "STY").otherwise("M"), F.lit(", "), F.when(F.col("p_size") % 3 == 0, "fix").otherwise("opt"), F.lit(", any, Mod"), F.col("p_partkey").cast("string"), F.lit("  # note"))
    got = parameters.read_any(p.sparkSession, _lines(p, line, "mods.txt"))
    return got.select("name", "residue", "is_fixed", F.col("composition")["O"].cast("long").alias("oxygens"))


@query("parameter_file", """SELECT 6 + min(p_size) AS min_length, 60 + max(p_size) AS max_length, min(p_retailprice) / 100 AS precursor_ppm, false AS tag_search, CAST(count(DISTINCT p_brand) AS INT) AS max_modifications FROM part""")
def parameter_file(t):
    # a file of options that says what is in the table
    said = t("part").agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"), (F.min("p_retailprice") / 100).alias("c"), F.count_distinct("p_brand").alias("d"))
    text = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    each = F.array(text("MinLength=", (6 + F.col("a")).cast("string"), " ; least"), text("maxLength=", (60 + F.col("b")).cast("string")), text("PMTolerance=", F.col("c").cast("string"), "ppm"), F.lit("TagSearch=false"), text("NumMods=", F.col("d").cast("string")), F.lit("Unknown=x"))
    spark = said.sparkSession
    o = parameters.read_parameters(spark, _lines(said.select(F.explode(each).alias("value")), F.col("value"), "x.params"))
    again = parameters.parse_parameters(parameters.format_parameters(o))
    return spark.createDataFrame([(again.min_length, again.max_length, again.precursor_ppm, again.tag_search, again.max_modifications)], "min_length int, max_length int, precursor_ppm double, tag_search boolean, max_modifications int")


@query("score_tables", """SELECT 'score' AS name, CAST(n_regionkey AS INT) AS mass_bin, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS bin, n_nationkey / 4 AS score FROM nation""")
def score_tables(t):
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    s = t("nation").select(F.col("n_regionkey").cast("int").alias("mass_bin"), place.alias("bin"), (F.col("n_nationkey") / 4).alias("score"))
    path = f"{shared_folder(s.sparkSession)}/score.tsv"
    training.write_score_table(s, path)
    return training.read_score_table(s.sparkSession, path, "score")


@query("dataset_list", """SELECT s_name AS Label, 'raw' || s_suppkey AS RawFilePath, 'ft' || s_suppkey AS FeatureFilePath, CASE WHEN s_suppkey % 2 = 0 THEN 'id' || s_suppkey END AS IdFilePath FROM supplier""")
def dataset_list(t):
    s = t("supplier")
    line = F.concat_ws("\t", "s_name", F.concat(F.lit("raw"), "s_suppkey"), F.concat(F.lit("ft"), "s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("id"), "s_suppkey")))
    return tables.read_datasets(s.sparkSession, _lines(s, line, "sets.tsv"))


@query("crosstab_sink", """SELECT c_nationkey, round(sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 2) AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1""")
def crosstab_sink(t):
    from spectroloom.operators.aggregates import crosstab

    c = t("customer").withColumn("kind", F.lower("c_mktsegment"))
    table = crosstab(c, ["c_nationkey"], "kind", ["building", "machinery"], {"Abundance": F.sum("c_acctbal"), "N": F.count(F.lit(1))})
    path = shared_folder(c.sparkSession) + "/cross.tsv"
    tables.write_crosstab(table, path, "c_nationkey")
    back = tables.read_delimited(c.sparkSession, path)
    return back.select(F.col("c_nationkey").cast("long").alias("c_nationkey"), F.round(F.col("building_Abundance").cast("double"), 2).alias("building"), F.coalesce(F.col("machinery_N").cast("long"), F.lit(0).cast("long")).alias("machinery"))
