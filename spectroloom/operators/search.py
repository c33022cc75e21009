"""The fixed pipelines: ingest, feature finding, search, false discovery rate and alignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.functions.arrays import upper_quantile
from spectroloom.functions.mass import ION_SERIES, PROTON, RESIDUE_MASS, WATER, nominal_bin
from spectroloom.operators import deconvolution, evidence, features, ranking, scoring, sequences, shifted, sweeps, tags, windows
from spectroloom.operators.joins import band_join
from spectroloom.operators.scratch import materialised
from spectroloom.sources import parameters, spectra, tables
from spectroloom.sources.fasta import with_decoys


def ingest(spark: SparkSession, path: str, out: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Converts a run of any readable format to a Parquet folder, once, and reads it."""
    raw = parameters.read_any(spark, path)
    if first is not None or last is not None:
        raw = raw.where(F.col("scan_num").between(first if first is not None else 0, last if last is not None else 2**31 - 1))
    spectra.write_run(raw, out)
    return spectra.read_run(spark, out)


def find_features(runs: DataFrame, charges: tuple[int, int] = (1, 60), ppm: float = 10.0, masses: tuple[float, float] = (600.0, 50000.0), least_cells: int = 2) -> DataFrame:
    """Features of the MS1 spectra of ``runs`` (run, scan_num, ms_level, elution_time, mz, intensity), by sweeps over mass ranges."""
    return sweeps.swept_features(runs, charges, masses, ppm, least_cells)


def candidates(proteins: DataFrame, options: parameters.SearchParameters) -> DataFrame:
    """Sequences of the proteins by cleavage mode: none (intact), single (one end trimmed), multiple (all
    substrings) or enzyme (bottom-up: peptides between cuts behind K and R)."""
    cut = {
        "none": lambda p: sequences.intact_sequences(p, "sequence", options.min_length, options.max_length, 1),
        "single": lambda p: sequences.terminal_cleavages(p, "sequence", options.min_length, options.max_length, 1, 0),
        "enzyme": lambda p: sequences.digested(p, "sequence", options.extra.get("residues", "KR"), options.min_length, options.max_length, int(options.extra.get("missed", 1)), int(options.extra.get("termini", 2))),
        "multiple": lambda p: sequences.all_substrings(p, "sequence", options.min_length, options.max_length, distinct=True),
    }[options.cleavage]
    return cut(proteins).drop("sequence").withColumnRenamed("peptide", "sequence")


def _node_scores(matches: DataFrame, peaks: DataFrame) -> DataFrame:
    """match_id with ``nodes``: what a cleavage at each nominal prefix mass of the match would score, from its spectrum's peaks."""
    near = matches.select("match_id", "scan_num", (F.col("mass") - WATER).alias("residues"), "series").join(peaks, "scan_num")
    offsets = F.create_map(*[x for k, (_, o) in ION_SERIES.items() for x in (F.lit(k), F.lit(o))])
    each = near.withColumn("ion", F.explode("series")).withColumn("prefix", F.col("ion").isin("a", "b", "c"))
    own = F.col("peak_mass") - F.element_at(offsets, F.col("ion"))
    each = each.withColumn("bin", F.when(F.col("prefix"), nominal_bin(own)).otherwise(nominal_bin(F.col("residues")) - nominal_bin(own)))
    term = scoring.composite_term(F.col("prefix"), F.col("peak_intensity"), F.col("reference"), F.col("corr"), F.col("dist"), F.lit(0.0))
    best = each.where("bin > 0").groupBy("match_id", "bin", "ion").agg(F.first("prefix").alias("prefix"), F.max(term).alias("t"))
    both = F.when(F.bool_or("prefix") & F.bool_or(~F.col("prefix")), F.lit(scoring.COMPLEMENTARY * scoring.SCALE)).otherwise(F.lit(0.0))
    nodes = best.groupBy("match_id", "bin").agg(F.bround(F.sum("t") + both).cast("int").alias("score"))
    return nodes.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(F.col("bin").cast("int").alias("mass"), "score"))).alias("nodes"))


def _matched_terms(ions: DataFrame, peaks: DataFrame, ppm: float, fragment: list[str]) -> DataFrame:
    """Matched fragments with what they add to the composite score, with and without their error."""
    took = ["corr", "dist", "reference"]
    matched = scoring.match_fragments(ions, peaks, "fragment_mass", "peak_mass", "peak_intensity", ppm, fragment, ["scan_num"], took)
    term = lambda error: scoring.composite_term(F.col("prefix"), F.col("matched_intensity"), F.col("reference"), F.col("corr"), F.col("dist"), error)
    return matched.withColumn("prefix", F.col("ion").isin("a", "b", "c")).withColumn("term", term(F.col("error_ppm"))).withColumn("plain_term", term(F.lit(0.0)))


def _with_reference(peaks: DataFrame) -> DataFrame:
    """Peaks as the scores take them: corr 1 and dist 0 where they have none, and their spectrum's reference intensity."""
    corr = F.col("corr") if "corr" in peaks.columns else F.lit(1.0)
    dist = F.col("dist") if "dist" in peaks.columns else F.lit(0.0)
    found = peaks.select("scan_num", F.col("mass").alias("peak_mass"), F.col("intensity").alias("peak_intensity"), corr.alias("corr"), dist.alias("dist"))
    level = found.groupBy("scan_num").agg(upper_quantile(F.collect_list("peak_intensity")).alias("reference"))
    return found.join(level, "scan_num")


def search(runs: DataFrame, proteins: DataFrame, modifications: dict[str, tuple[float, str]] | None = None, options: parameters.SearchParameters | None = None, peaks: DataFrame | None = None) -> DataFrame:
    """Target and decoy matches of the fragment spectra of ``runs``, the best ``report`` of each scan, with q-values.

    Precursor masses come from the isolation's monoisotopic m/z and charge. ``modifications`` maps
    a name to (mass shift, residues); with them each match is scored by its best placement of them,
    ``placement`` (name or empty of each residue). Proteins have name and sequence. Matches are scored by the
    composite score over the series of their scan's ``activation`` (c and z for ETD, b and y unless told otherwise), and
    E-values count random sequences of the same, modified residues that score as well, times the number of proteins.
    """
    options = options or parameters.SearchParameters()
    modifications = modifications or {}
    masses, sites = {k: v[0] for k, v in modifications.items()}, {k: v[1] for k, v in modifications.items()}
    both = with_decoys(proteins.select("name", "description", "sequence"))
    ms2 = runs.where((F.col("ms_level") == 2) & F.col("isolation.mono_mz").isNotNull() & F.col("isolation.charge").between(options.min_charge, options.max_charge))
    activation = F.lit(options.activation.upper()) if options.activation != "unknown" or "activation" not in runs.columns else F.upper("activation")
    scans = ms2.select("scan_num", ((F.col("isolation.mono_mz") - PROTON) * F.col("isolation.charge")).alias("precursor_mass"), F.col("isolation.charge").alias("charge"), scoring.series_of(activation).alias("series"))
    forms = sequences.proteoforms(candidates(both, options), "sequence", masses, sites, options.max_modifications if masses else 0).where(F.col("mass").between(options.min_mass, options.max_mass))
    pairs = band_join(scans, forms, "precursor_mass", "mass", options.precursor_ppm, "ppm")
    pairs = materialised(pairs.withColumn("match_id", F.xxhash64("scan_num", "name", "sequence", "start", "modifications")))
    if peaks is None:
        peaks = deconvolution.deconvolute(ms2, ["scan_num"], (options.min_product_charge, options.max_product_charge), options.product_ppm)
    found = materialised(_with_reference(peaks))
    every = tuple(dict.fromkeys(("b", "y", *[s for kinds in scoring.SERIES.values() for s in kinds])))
    ions = sequences.fragments(pairs.select("match_id", "scan_num", "sequence", "modifications", "series"), "sequence", every).where(F.array_contains("series", F.col("ion")))
    fragment = ["match_id", "scan_num", "ion", "cut"]
    if masses:
        # a fragment is matched once with each part of the modifications that it may carry; placements share these
        combos = sequences.modification_combinations(list(masses), options.max_modifications)
        parts = runs.sparkSession.createDataFrame(sequences.modification_parts(combos, masses), "modifications array<string>, parts array<struct<part:array<string>,shift:double>>")
        ions = ions.join(F.broadcast(parts), "modifications").select(*fragment, "fragment_mass", F.inline("parts")).withColumn("fragment_mass", F.col("fragment_mass") + F.col("shift"))
        matched = _matched_terms(ions, found, options.product_ppm, [*fragment, "part"])
        scored = scoring.placed_composite(matched.join(pairs.select("match_id", "sequence", "modifications"), "match_id"), ["match_id", "scan_num"], sites)
    else:
        matched = _matched_terms(ions, found, options.product_ppm, fragment)
        scored = scoring.composite(matched.join(pairs.select("match_id", F.length("sequence").alias("residues")), "match_id"), ["match_id", "scan_num"], "residues")
    best = ranking.top_k_distinct_scores(scored, ["scan_num"], "score", [F.col("match_id")], options.keep)
    results = materialised(best.join(pairs.drop("scan_num"), "match_id"))
    with_nodes = results.join(_node_scores(results, found), "match_id").withColumn("target", nominal_bin(F.col("mass") - WATER).cast("int"))
    steps = RESIDUE_MASS | {f"{r}+{name}": RESIDUE_MASS[r] + shift for name, (shift, residues) in modifications.items() for r in residues if r in RESIDUE_MASS}
    e = scoring.generating_function(with_nodes, ["match_id"], "target", "nodes", "plain_score", steps)
    final = results.join(e, "match_id").withColumn("e_value", F.col("spec_e_value") * proteins.count()).withColumn("probability", scoring.probability(F.col("score")))
    reported = ranking.top_n_with_ties(final.drop("series", "plain_score"), ["scan_num"], "e_value", [F.col("match_id")], options.report)
    return windows.target_decoy_fdr(reported, "scan_num", "sequence", "e_value", "probability", "is_decoy", [F.col("match_id")])


def fdr_of_files(spark: SparkSession, target: str, decoy: str) -> DataFrame:
    """Target and decoy result tables as one with QValue and PepQValue; fails where either is empty."""
    t, d = tables.read_results(spark, target), tables.read_results(spark, decoy)
    for name, df in (("target", t), ("decoy", d)):
        if not tables.has_rows(df):
            raise ValueError(f"Cannot compute FDR Scores; {name} results file is empty")
    both = d.withColumn("is_decoy", F.lit(True)).unionByName(t.withColumn("is_decoy", F.lit(False)), allowMissingColumns=True).drop("QValue", "PepQValue")
    both = both.withColumn("is_decoy", F.col("ProteinName").startswith("XXX")).withColumn("_peptide", F.concat_ws(".", "Pre", "Sequence", "Post"))
    done = windows.target_decoy_fdr(both, "Scan", "_peptide", "EValue", "Probability", "is_decoy", [F.col("Sequence"), F.col("ProteinName"), F.col("Start")])
    return done.withColumnsRenamed({"q_value": "QValue", "pep_q_value": "PepQValue"}).drop("_peptide")


def scorer(peaks: DataFrame, ppm: float = 10.0, activation: str = "CID") -> Callable[[DataFrame], DataFrame]:
    """What scores sequences against spectra of one kind: takes (scan_num, sequence), gives them distinct with
    ``n_matched`` and ``score``, the composite score over the activation's series. Pairs without a fragment are left out.
    """
    found, series = _with_reference(peaks), scoring.SERIES.get(activation.upper(), ("b", "y"))

    def score(pairs: DataFrame) -> DataFrame:
        rows = pairs.select("scan_num", "sequence").distinct().withColumn("match_id", F.xxhash64("scan_num", "sequence"))
        matched = _matched_terms(sequences.fragments(rows, "sequence", series), found, ppm, ["match_id", "scan_num", "ion", "cut"])
        scored = scoring.composite(matched.join(rows.select("match_id", F.length("sequence").alias("residues")), "match_id"), ["match_id"], "residues")
        return rows.join(scored.drop("plain_score"), "match_id").drop("match_id")

    return score


def rescore(results: DataFrame, peaks: DataFrame, ppm: float = 10.0, activation: str = "CID") -> DataFrame:
    """``results`` (Scan, Sequence) with the composite score over new peaks (scan_num, mass, intensity); null where no fragment matches."""
    scored = scorer(peaks, ppm, activation)(results.select(F.col("Scan").alias("scan_num"), F.col("Sequence").alias("sequence")))
    return results.join(scored.withColumnsRenamed({"scan_num": "Scan", "sequence": "Sequence"}), ["Scan", "Sequence"], "left")


def tag_search(scans: DataFrame, peaks: DataFrame, proteins: DataFrame, least: int = 5, most: int = 8, ppm: float = 10.0, da: float = 0.01, shifts: Sequence[float] = (0.0,), most_hits: int = 10**9, activation: str = "CID", unknown: tuple[float, float] | None = None, modifications: dict[str, tuple[float, str]] | None = None, most_modifications: int = 0) -> DataFrame:
    """(scan_num, name, start, stop, sequence, left_shift, right_shift, n_matched, score): proteins found by sequence tags.

    ``scans`` are (scan_num, precursor_mass). Tags of ``least`` to ``most`` residues are read off the deconvoluted peaks as
    prefix fragments, and backwards as suffix fragments; where one stands on a protein, its flanking masses are made up by the
    residues around it, with one of ``shifts`` on either side. What is found is scored as a whole, without the shifts.

    With ``unknown`` (least and greatest) or ``modifications`` the sides are made up by the best placement of these, any mass
    within ``unknown`` may hang on an end of the protein, fragments are scored with what they carry, and ``placement`` is
    added (modification or empty of each residue).
    """
    series = scoring.SERIES.get(activation.upper(), ("b", "y"))
    prefix, suffix = ION_SERIES[series[0]][1], ION_SERIES[series[-1]][1]
    nodes = materialised(peaks.select("scan_num", "mass").distinct().withColumn("node", F.monotonically_increasing_id()))
    paths = tags.tag_paths(tags.tag_edges(nodes, ["scan_num"], "mass", "node", ppm), ["scan_num"], least, most)
    ends = nodes.select("node", F.col("mass").alias("end_mass"))
    read = paths.join(ends.withColumnsRenamed({"node": "start_node", "end_mass": "low"}), "start_node").join(ends.withColumnsRenamed({"node": "stop_node", "end_mass": "high"}), "stop_node")
    read = materialised(read.select("scan_num", "tag", "low", "high").distinct())
    hits = tags.tags_on_proteins(read.select("tag"), proteins, "name", "sequence", least, most_hits).drop("pattern")
    whole = F.col("precursor_mass") - WATER
    placed = read.join(hits, "tag").join(scans.select("scan_num", "precursor_mass"), "scan_num")
    before = F.when(F.col("reversed"), whole - (F.col("high") - suffix)).otherwise(F.col("low") - prefix)
    after = F.when(F.col("reversed"), F.col("low") - suffix).otherwise(whole - (F.col("high") - prefix))
    placed = placed.withColumn("before", before).withColumn("after", after).select("scan_num", "name", "position", "tag", "before", "after").distinct()
    if unknown is not None or modifications:
        return shifted.shifted_matches(placed, peaks, proteins, modifications, most_modifications, shifts, unknown, ppm, da, activation)
    found = evidence.extended_tags(placed, proteins, "name", "sequence", "position", "tag", "before", "after", da, shifts)
    found = found.select("scan_num", "name", "start", "stop", F.col("matched").alias("sequence"), "left_shift", "right_shift").distinct()
    return found.join(scorer(peaks, ppm, activation)(found), ["scan_num", "sequence"])


def feature_tag_search(features_of: DataFrame, scans: DataFrame, peaks: DataFrame, proteins: DataFrame, **options) -> DataFrame:
    """``tag_search`` of the fragment scans that a feature covers: with ``feature``, precursor masses are the features'.

    ``features_of``: feature, mass, min_scan, max_scan; ``scans``: scan_num and precursor_mass, which lies within 10 ppm of
    the feature's.
    """
    near = band_join(scans, features_of.select("feature", F.col("mass").alias("feature_mass"), "min_scan", "max_scan"), "precursor_mass", "feature_mass", 10.0, "ppm")
    own = near.where(F.col("scan_num").between(F.col("min_scan"), F.col("max_scan"))).select("feature", "scan_num", F.col("feature_mass").alias("precursor_mass"))
    return tag_search(own.select("scan_num", "precursor_mass").distinct(), peaks.join(own.select("scan_num").distinct(), "scan_num", "left_semi"), proteins, **options).join(own.select("feature", "scan_num"), "scan_num")


def align(tables_by_run: dict[str, DataFrame], ppm: float = 10.0, net: float = 0.01) -> DataFrame:
    """The crosstab of feature tables (as their files have them) over runs."""
    every = None
    for run, df in tables_by_run.items():
        # one row, the run's last time, is joined
        end = df.agg(F.max("MaxElutionTime").alias("_end"))
        one = df.join(F.broadcast(end)).select(F.lit(run).alias("run"), F.xxhash64(F.lit(run), "FeatureID").bitwiseAND(F.lit(2**62 - 1)).alias("feature"), F.col("MonoMass").alias("mass"), ((F.col("MinElutionTime") + F.col("MaxElutionTime")) / 2 / F.col("_end")).alias("net"), F.col("Abundance").alias("abundance"))
        every = one if every is None else every.unionByName(one)
    return features.alignment_crosstab(features.aligned(every, ppm, net), list(tables_by_run))
