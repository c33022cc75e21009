import base64
import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spectroloom.operators import search
from spectroloom.sources import fasta, parameters, spectra, tables


def text_file(path, content):
    path.write_text(content)
    return str(path)


def test_fasta(spark, tmp_path):
    p = text_file(tmp_path / "a.fasta", ">P1 first protein\nMKV\nLAA\n>P2\n\n>P3 third\r\nGG G\r\n")
    got = {r["name"]: (r["description"], r["sequence"]) for r in fasta.read_fasta(spark, p).collect()}
    assert got == {"P1": ("first protein", "MKVLAA"), "P2": ("", ""), "P3": ("third", "GGG")}
    both = fasta.with_decoys(fasta.read_fasta(spark, p))
    assert {r["name"]: r["sequence"] for r in both.where("is_decoy").collect()} == {"XXX_P1": "AALVKM", "XXX_P2": "", "XXX_P3": "GGG"}
    assert [tuple(r) for r in fasta.with_offsets(fasta.read_fasta(spark, p)).orderBy("name").select("name", "start_offset").collect()] == [("P1", 0), ("P2", 7), ("P3", 8)]
    fasta.write_fasta(fasta.read_fasta(spark, p), str(tmp_path / "out"), 4)
    back = {r["name"]: r["sequence"] for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert back == {"P1": "MKVLAA", "P2": "", "P3": "GGG"}
    assert fasta.valid_extension("x.FA") and not fasta.valid_extension("x.txt")


FEATURES = "FeatureID\tMinScan\tMaxScan\tMinCharge\tMaxCharge\tMonoMass\tRepScan\tRepCharge\tRepMz\tAbundance\tApexScanNum\tApexIntensity\tMinElutionTime\tMaxElutionTime\tElutionLength\tEnvelope\tLikelihoodRatio\n1\t10\t20\t2\t5\t8472.3354\t12\t3\t900.1\t1234.5\t13\t99.5\t1.5\t2.5\t1.0\t0,0.500;1,1.000\t12.5\n2\t30\t31\t2\t2\t1000.0\t30\t2\t501.0\t5\t30\t1\t3\t4\t1\t\t0\n"


def test_features(spark, tmp_path):
    df = tables.read_features(spark, text_file(tmp_path / "a.ms1ft", FEATURES))
    one = df.where("FeatureID = 1").first()
    assert one["MonoMass"] == 8472.3354 and [tuple(e) for e in one["isotopes"]] == [(0, 0.5), (1, 1.0)]
    assert df.where("FeatureID = 2").first()["isotopes"] == []
    tables.write_features(df, str(tmp_path / "out"))
    again = tables.read_features(spark, str(tmp_path / "out"))
    assert again.count() == 2 and again.where("FeatureID = 1").first()["Envelope"] == "0,0.500;1,1.000"
    cross = search.align({"a": df, "b": df.withColumn("MonoMass", F.col("MonoMass") + 0.001)}).collect()
    assert len(cross) == 2 and all(r["a_Abundance"] == r["b_Abundance"] for r in cross)


HEADER = "Scan\tPre\tSequence\tPost\tModifications\tComposition\tProteinName\tProteinDesc\tProteinLength\tStart\tEnd\tCharge\tMostAbundantIsotopeMz\tMass\tMs1Features\t#MatchedFragments\tProbability\tSpecEValue\tEValue"


def result(scan, seq, protein, e):
    return f"{scan}\tK\t{seq}\tR\t\tC(1)\t{protein}\td\t100\t1\t9\t3\t500.1\t1500.2\t1\t12\t0.9\t{e}\t{e}"


def test_results_and_fdr(spark, tmp_path):
    t = text_file(tmp_path / "x_IcTarget.tsv", "\n".join([HEADER, result(1, "AAA", "P1", 1e-9), result(2, "BBB", "P2", 1e-3), result(3, "CCC", "P3", 1.0)]) + "\n")
    d = text_file(tmp_path / "x_IcDecoy.tsv", "\n".join([HEADER, result(1, "ZZZ", "XXX_P1", 1e-2), result(3, "YYY", "XXX_P3", 0.5), result(4, "WWW", "XXX_P4", 5.0)]) + "\n")
    got = {r["Scan"]: (r["Sequence"], round(r["QValue"], 6)) for r in search.fdr_of_files(spark, t, d).collect()}
    assert got == {1: ("AAA", 0.0), 2: ("BBB", 0.0), 3: ("YYY", 0.5), 4: ("WWW", 1.0)}
    empty = text_file(tmp_path / "y_IcDecoy.tsv", HEADER + "\n")
    with pytest.raises(ValueError, match="decoy results file is empty"):
        search.fdr_of_files(spark, t, empty)
    assert tables.read_results(spark, t).first()["NumMatchedFragments"] == 12
    low = tables.with_tiny_floor(tables.read_results(spark, t).withColumn("EValue", F.lit(0.0))).first()
    assert low["EValue"] == 9.99e-308
    xml = "\n".join(r["value"] for r in parameters.identification_xml(tables.read_results(spark, t)).orderBy("part", "key").collect())
    from xml.etree import ElementTree

    root = ElementTree.fromstring(xml.encode())
    assert len(root.findall(".//SpectrumIdentificationResult")) == 3 and len(root.findall(".//DBSequence")) == 3


def test_other_tables(spark, tmp_path):
    p = text_file(tmp_path / "a_isos.csv", "scan_num,charge,monoisotopic_mw,fit\n1,2,1000.5,0.1\n2,1,5,0.1\n3,3,7,2.5\n")
    assert [r["scan_num"] for r in tables.read_isotope_peaks(spark, p).collect()] == [1]
    p = text_file(tmp_path / "d.tsv", "Label\tRaw\tMs1Ft\n\ta.raw\ta.ms1ft\nB\tb.raw\tb.ms1ft\tb.tsv\nshort\trow\n")
    assert [tuple(r) for r in tables.read_datasets(spark, p).collect()] == [("Dataset_1", "a.raw", "a.ms1ft", None), ("B", "b.raw", "b.ms1ft", "b.tsv")]
    p = text_file(tmp_path / "scans.txt", "1\t2,3\n 40 2\n")
    assert sorted(r["scan_num"] for r in tables.read_scan_list(spark, p).collect()) == [1, 2, 3, 40]
    p = text_file(tmp_path / "tags.tsv", "ScanNum\tSequenceTag\tIsPrefix\tFlankingMass\tScore\n1\tABCDE\t1\t10.5\t3\n1\tABCDF\t1\t10.5\t5\n1\tAB\t0\t1\t9\n")
    assert [r["sequencetag"] for r in tables.read_tags(spark, p, 5, 1).collect()] == ["ABCDF"]
    p = text_file(tmp_path / "msgf.tsv", "Scan\tPeptide\tPrecursorMZ\tProtein\tMSGFScore\tCharge\tQValue\n5\tK.AB.R\t500.5\tP1\t30\t2\t0.001\n6\tK.AB.R\t500.5\tXXX_P1\t30\t2\t0.001\n7\tA\t1\tP\t1\t1\t0.5\n")
    m = tables.read_matches(spark, p).collect()
    assert [(r["scan"], r["tool"], round(r["mass"], 3)) for r in m] == [(5, "generating_function", 998.985)]


def test_ragged_rows(spark, tmp_path):
    p = text_file(tmp_path / "r.tsv", "# note\nA\tB\n1\t2\r\n3\n4\t5\t6\n7\t\"q\n")
    assert sorted((r["A"], r["B"]) for r in tables.read_delimited(spark, p, comment="#").collect()) == [("1", "2"), ("3", None), ("7", '"q')]


def test_modifications_and_parameters(spark, tmp_path):
    p = text_file(tmp_path / "mods.txt", "NumMods=4 # at most\n\nO1,MW,opt,any,Oxidation # comment\nC2H2O,*,opt,Prot-N-term,Acetyl\nH(-1),C,fix,any,Dehydro\n")
    got = sorted((r["name"], r["residue"], r["is_fixed"], r["location"], tuple(sorted(r["composition"].items()))) for r in parameters.read_modifications(spark, p).collect())
    assert got == [("Acetyl", "*", False, "prot-n-term", (("C", 2), ("H", 2), ("O", 1))), ("Dehydro", "C", True, "any", (("H", -1),)), ("Oxidation", "M", False, "any", (("O", 1),)), ("Oxidation", "W", False, "any", (("O", 1),))]
    assert parameters.most_modifications(spark, p) == 4
    p = text_file(tmp_path / "p.txt", "# head\nMinLength=30 ; note\nPMTolerance=5ppm\nTagSearch=False\nOther=x\n")
    o = parameters.read_parameters(spark, p)
    assert (o.min_length, o.precursor_ppm, o.tag_search, o.extra) == (30, 5.0, False, {"other": "x"}) or o.extra == {"Other": "x"}
    with pytest.raises(ValueError, match="convert it"):
        parameters.read_any(spark, "run.raw")


def array(values, accession, compress, kind):
    raw = struct.pack(f"<{len(values)}{kind}", *values)
    raw = zlib.compress(raw) if compress else raw
    return f'<binaryDataArray><cvParam accession="{"MS:1000523" if kind == "d" else "MS:1000521"}"/><cvParam accession="{"MS:1000574" if compress else "MS:1000576"}"/><cvParam accession="{accession}"/><binary>{base64.b64encode(raw).decode()}</binary></binaryDataArray>'


def mzml_spectrum(index, scan, level, minutes, mz, intensity, precursor=""):
    return (
        f'<spectrum index="{index}" id="controllerType=0 controllerNumber=1 scan={scan}" defaultArrayLength="{len(mz)}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000285" value="{sum(intensity)}"/>'
        f'<scanList><scan><cvParam accession="MS:1000016" value="{minutes * 60}" unitName="second"/></scan></scanList>{precursor}<binaryDataArrayList>{array(mz, "MS:1000514", True, "d")}{array(intensity, "MS:1000515", False, "f")}</binaryDataArrayList></spectrum>\n'
    )


PRECURSOR = '<precursorList><precursor><isolationWindow><cvParam accession="MS:1000827" value="{0}"/><cvParam accession="MS:1000828" value="1"/><cvParam accession="MS:1000829" value="1.5"/></isolationWindow><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="{0}"/><cvParam accession="MS:1000041" value="{1}"/></selectedIon></selectedIonList><activation><cvParam accession="MS:1000422"/></activation></precursor></precursorList>'


def mzml(*bodies):
    return '<?xml version="1.0"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>\n' + "".join(bodies) + "</spectrumList></run></mzML>\n"


def test_mzml_and_runs(spark, tmp_path):
    doc = mzml(mzml_spectrum(0, 1, 1, 0.5, [400.25, 500.5], [10.0, 20.0]), mzml_spectrum(1, 2, 2, 0.6, [100.0], [1.0], PRECURSOR.format(500.5, 3)), mzml_spectrum(2, 3, 1, 0.7, [], []))
    plain, packed = text_file(tmp_path / "a.mzML", doc), tmp_path / "b.mzML.gz"
    packed.write_bytes(gzip.compress(doc.encode()))
    for p in (plain, str(packed)):
        got = {r["scan_num"]: r for r in parameters.read_any(spark, p).collect()}
        assert got[1]["mz"] == [400.25, 500.5] and got[1]["intensity"] == [10.0, 20.0] and got[1]["elution_time"] == pytest.approx(0.5)
        assert got[2]["isolation"].asDict() == {"mono_mz": 500.5, "charge": 3, "target_mz": 500.5, "lower": 1.0, "upper": 1.5} and got[2]["activation"] == "HCD"
        assert got[3]["mz"] == [] and got[1]["isolation"] is None
    assert spectra.read_mzml(spark, plain, peaks=False).where("size(mz) > 0").count() == 0
    run = search.ingest(spark, plain, str(tmp_path / "run"))
    assert run.count() == 3 and spectra.read_run(spark, str(tmp_path / "run"), 2, 3).count() == 2
    assert [r["mz"] for r in spectra.read_run_peaks(spark, str(tmp_path / "run"), 1, 450).collect()] == [500.5]


def test_mgf_and_msalign(spark, tmp_path):
    p = text_file(tmp_path / "a.mgf", "BEGIN IONS\nTITLE=one\nSCANS=7\nPEPMASS=500.25 100\nCHARGE=3+\nSEQ=PEPTIDE\n100.5 10\n200.25\t20.5\nEND IONS\n\nBEGIN IONS\nTITLE=two\nPEPMASS=1\nEND IONS\n")
    got = {r["title"]: r for r in spectra.read_mgf(spark, p).collect()}
    assert got["one"]["mz"] == [100.5, 200.25] and got["one"]["intensity"] == [10.0, 20.5] and (got["one"]["scan_num"], got["one"]["charge"], got["one"]["precursor_mz"], got["one"]["sequence"]) == (7, 3, 500.25, "PEPTIDE")
    assert got["two"]["mz"] == [] and got["two"]["sequence"] is None
    p = text_file(tmp_path / "a.msalign", "BEGIN IONS\nID=0\nSCANS=5\n1000.5\t20\t3\n900.25 1e3 2\nEND IONS\nBEGIN IONS\nSCANS=6\nEND IONS\n")
    assert sorted(tuple(r) for r in spectra.read_msalign(spark, p).collect()) == [(5, 900.25, 1000.0, 2), (5, 1000.5, 20.0, 3)]


def test_rejected_lines_and_several_files(spark, tmp_path):
    p = text_file(tmp_path / "a.tsv", "a\tb\n1\t2\n1\t2\t3\n4\n")
    assert [r["line"] for r in tables.rejected_lines(spark, p).collect()] == ["1\t2\t3"]
    assert sorted(str(tuple(r)) for r in tables.read_delimited(spark, p).collect()) == ["('1', '2')", "('4', None)"]
    table = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    tables.write_crosstab(table.repartition(6), str(tmp_path / "many"), "k", one_file=False)
    assert len(list((tmp_path / "many").glob("part-*.csv"))) > 1
    assert tables.read_delimited(spark, str(tmp_path / "many")).count() == 1000
