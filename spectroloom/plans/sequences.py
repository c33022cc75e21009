"""Queries of enumeration, fragments, tags and features."""

from pyspark.sql import functions as F

from spectroloom.functions import numeric
from spectroloom.functions.mass import RESIDUE_MASS, RESIDUES
from spectroloom.operators import features, graph, scoring, sequences, suffixes, tags
from spectroloom.operators.joins import band_join
from spectroloom.plans.registry import query


def _proteins(t):
    return t("part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"))


SEQ = "p AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS s FROM part)"
CUT = "CASE WHEN a = 0 THEN '-' ELSE substr(s, a, 1) END AS pre, substr(s, a + 1, b - a) AS peptide, CASE WHEN b >= length(s) THEN '-' ELSE substr(s, b + 1, 1) END AS post, a + 1 AS start"


@query("intact_sequences", f"""WITH {SEQ}, c AS (SELECT p_partkey, s, 0 AS a, length(s) - t AS b FROM p, range(0, 4) r(t)) SELECT p_partkey, {CUT} FROM c WHERE b BETWEEN 6 AND 12""")
def intact_sequences(t):
    return sequences.intact_sequences(_proteins(t), "sequence", 6, 12, 3).select("p_partkey", "pre", "peptide", "post", "start")


@query("terminal_cleavages", f"""WITH {SEQ}, c AS (SELECT p_partkey, s, n AS a, length(s) - k AS b, k FROM p, range(0, 40) r(n), range(0, 40) q(k) WHERE n + k <= length(s) AND (k <= 1 OR n <= 2))
SELECT p_partkey, {CUT} FROM c WHERE b - a BETWEEN 5 AND 11""")
def terminal_cleavages(t):
    return sequences.terminal_cleavages(_proteins(t), "sequence", 5, 11, 2, 1).select("p_partkey", "pre", "peptide", "post", "start")


@query("all_substrings_distinct", f"""WITH {SEQ}, c AS (SELECT p_partkey, s, a, b FROM p, range(0, 40) r(a), range(0, 40) q(b) WHERE b <= length(s) AND b - a BETWEEN 4 AND 6) SELECT DISTINCT pre, peptide FROM (SELECT {CUT} FROM c)""")
def all_substrings_distinct(t):
    return sequences.all_substrings(_proteins(t), "sequence", 4, 6, distinct=True).select("pre", "peptide")


DIGEST = f"""WITH {SEQ}, x AS (SELECT *, list_distinct(list_concat([0, length(s)], list_filter(range(1, length(s)), lambda i: substr(s, i, 1) IN ('K', 'R', 'E')))) AS cuts FROM p),
c AS (SELECT p_partkey, s, a, b, len(list_filter(cuts, lambda i: i > a AND i < b)) AS missed_cleavages, CAST(list_contains(cuts, a) AS INT) + CAST(list_contains(cuts, b) AS INT) AS ends FROM x, range(0, 40) r(a), range(0, 40) q(b) WHERE b <= length(s))"""


@query("enzymatic_digest", f"""{DIGEST} SELECT p_partkey, missed_cleavages, {CUT} FROM c WHERE b - a BETWEEN 3 AND 30 AND ends = 2 AND missed_cleavages <= 1""")
def enzymatic_digest(t):
    return sequences.digested(_proteins(t), "sequence", "KRE", 3, 30, 1, 2).select("p_partkey", F.col("missed_cleavages").cast("long").alias("missed_cleavages"), "pre", "peptide", "post", "start")


@query("semi_enzymatic_digest", f"""{DIGEST} SELECT p_partkey, missed_cleavages, {CUT} FROM c WHERE b - a BETWEEN 4 AND 9 AND ends >= 1 AND missed_cleavages <= 1""")
def semi_enzymatic_digest(t):
    return sequences.digested(_proteins(t), "sequence", "KRE", 4, 9, 1, 1).select("p_partkey", F.col("missed_cleavages").cast("long").alias("missed_cleavages"), "pre", "peptide", "post", "start")


MODS = {"Ox": (15.994915, "MW"), "Phos": (79.966331, "STY")}
MASS_SQL = "r(r, m) AS (VALUES " + ", ".join(f"('{r}', {m!r})" for r, m in RESIDUE_MASS.items()) + ")"


@query("proteoform_masses", f"""WITH {SEQ}, {MASS_SQL}, l AS (SELECT p_partkey, unnest(string_split(s, '')) AS r FROM p),
w AS (SELECT p_partkey, sum(coalesce(m, 0)) + 2 * 1.007825035 + 15.99491463 AS m, count(*) FILTER (l.r IN ('M', 'W')) AS ox, count(*) FILTER (l.r IN ('S', 'T', 'Y')) AS ph FROM l LEFT JOIN r ON r.r = l.r GROUP BY p_partkey)
SELECT p_partkey, CAST(i AS INT) AS n_ox, CAST(j AS INT) AS n_phos, round(m + i * 15.994915 + j * 79.966331, 4) AS mass FROM w, range(0, 4) a(i), range(0, 4) b(j) WHERE i + j <= 3 AND i <= ox AND j <= ph""")
def proteoform_masses(t):
    done = sequences.proteoforms(_proteins(t), "sequence", {k: v[0] for k, v in MODS.items()}, {k: v[1] for k, v in MODS.items()}, 3)
    count = lambda name: F.size(F.filter("modifications", lambda m: m == name))
    return done.select("p_partkey", count("Ox").alias("n_ox"), count("Phos").alias("n_phos"), F.round("mass", 4).alias("mass"))


@query("proteoform_counts", f"""WITH {SEQ}, w AS (SELECT p_partkey, length(regexp_replace(s, '[^MW]', '', 'g')) AS ox, length(regexp_replace(s, '[^STY]', '', 'g')) AS ph FROM p)
SELECT p_partkey, count(*) AS n FROM w, range(0, 4) a(i), range(0, 4) b(j) WHERE i + j <= 3 AND i <= ox AND j <= ph GROUP BY p_partkey""")
def proteoform_counts(t):
    done = sequences.proteoforms(_proteins(t), "sequence", {k: v[0] for k, v in MODS.items()}, {k: v[1] for k, v in MODS.items()}, 3)
    return done.groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("fragment_ions", f"""WITH {SEQ}, {MASS_SQL}, l AS (SELECT p_partkey, s, i, coalesce(m, 0) AS m FROM (SELECT p_partkey, s, i, substr(s, i, 1) AS x FROM p, range(1, 40) q(i) WHERE i <= length(s)) LEFT JOIN r ON r = x),
b AS (SELECT p_partkey, i, length(s) AS n, sum(m) OVER (PARTITION BY p_partkey ORDER BY i) AS pre, sum(m) OVER (PARTITION BY p_partkey) AS total FROM l),
f AS (SELECT p_partkey, 'b' AS ion, i AS cut, pre AS fragment_mass FROM b WHERE i < n UNION ALL SELECT p_partkey, 'y', n - i, total - pre + 2 * 1.007825035 + 15.99491463 FROM b WHERE i < n)
SELECT p_partkey, ion, cut, CAST(z AS INT) AS charge, round(fragment_mass / z + 1.00727649, 5) AS ion_mz FROM f, range(1, 3) q(z)""")
def fragment_ions(t):
    done = sequences.fragments(_proteins(t), "sequence", ("b", "y"), (1, 2))
    return done.select("p_partkey", "ion", F.col("cut").cast("long").alias("cut"), "charge", F.round("ion_mz", 5).alias("ion_mz"))


def _mass_peaks(t):
    return t("lineitem").select("l_orderkey", (F.col("l_extendedprice") / 100).alias("mass"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("node")).distinct()


EDGES = f"""WITH {MASS_SQL}, p AS (SELECT DISTINCT l_orderkey, l_extendedprice / 100 AS mass, CAST(round(l_extendedprice * 100) AS BIGINT) AS node FROM lineitem),
e AS (SELECT a.l_orderkey, a.node AS from_node, b.node AS to_node, r.r AS residue FROM p a, r, p b
  WHERE r.r <> 'I' AND a.l_orderkey = b.l_orderkey AND abs(a.mass + r.m - b.mass) <= (a.mass + r.m) * 2000 / 1e6)"""


@query("tag_edges", f"{EDGES} SELECT * FROM e")
def tag_edges(t):
    return tags.tag_edges(_mass_peaks(t), ["l_orderkey"], "mass", "node", 2000.0).select("l_orderkey", "from_node", "to_node", "residue")


PATHS = f"""{EDGES}, w AS (SELECT a.l_orderkey, a.from_node AS start_node, b.to_node AS stop_node, a.residue || b.residue AS tag FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.to_node = b.from_node)"""


@query("tag_paths", f"{PATHS} SELECT * FROM w")
def tag_paths(t):
    edges = tags.tag_edges(_mass_peaks(t), ["l_orderkey"], "mass", "node", 2000.0)
    return tags.tag_paths(edges, ["l_orderkey"], 2, 2).select("l_orderkey", "start_node", "stop_node", "tag")


@query("tag_paths_by_joins", f"{PATHS} SELECT * FROM w")
def tag_paths_by_joins(t):
    edges = tags.tag_edges(_mass_peaks(t), ["l_orderkey"], "mass", "node", 2000.0)
    return tags.paths_of_length(edges, ["l_orderkey"], 2)


@query("tag_counts", f"{PATHS} SELECT tag, count(*) AS n, count(DISTINCT l_orderkey) AS spectra FROM w GROUP BY tag")
def tag_counts(t):
    edges = tags.tag_edges(_mass_peaks(t), ["l_orderkey"], "mass", "node", 2000.0)
    return tags.tag_paths(edges, ["l_orderkey"], 2, 2).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("spectra"))


@query("tags_on_proteins", f"""WITH {SEQ}, g AS (SELECT DISTINCT substr(s, 2, 4) AS tag FROM p WHERE length(s) >= 5), i AS (SELECT p_partkey, replace(s, 'I', 'L') AS s FROM p),
b AS (SELECT tag, false AS reversed, tag AS pattern FROM g UNION ALL SELECT tag, true, reverse(tag) FROM g WHERE reverse(tag) <> tag)
SELECT i.p_partkey, b.tag, b.reversed, k AS position FROM (SELECT p_partkey, k, substr(s, k + 1, 4) AS piece FROM i, range(0, 60) r(k) WHERE k + 4 <= length(s)) i JOIN b ON i.piece = b.pattern""")
def tags_on_proteins(t):
    p = _proteins(t)
    found = tags.tags_on_proteins(p.where(F.length("sequence") >= 5).select(F.substring("sequence", 2, 4).alias("tag")), p, "p_partkey", "sequence", 4, 10**9)
    return found.select("p_partkey", "tag", "reversed", F.col("position").cast("long").alias("position"))


@query("fragment_matching", f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity * 1800 AS ion_mz FROM lineitem)
SELECT o.l_orderkey, o.l_linenumber, o.ion_mz, arg_max(b.l_extendedprice, (b.l_tax, b.l_extendedprice)) AS matched_mz, max(b.l_tax) AS matched_intensity FROM o JOIN lineitem b ON b.l_orderkey = o.l_orderkey
  AND abs(o.ion_mz - b.l_extendedprice) <= o.ion_mz * 30000 / 1e6 GROUP BY ALL""")
def fragment_matching(t):
    li = t("lineitem")
    ions = li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1800).alias("ion_mz"))
    peaks = li.select("l_orderkey", "l_extendedprice", "l_tax")
    done = scoring.match_fragments(ions, peaks, "ion_mz", "l_extendedprice", "l_tax", 30000.0, ["l_orderkey", "l_linenumber"], ["l_orderkey"])
    return done.select("l_orderkey", "l_linenumber", "ion_mz", "matched_mz", "matched_intensity")


@query("spectrum_similarity", """WITH x AS (SELECT l_suppkey, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS b, l_returnflag AS f, sum(l_quantity) AS i FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(sum(coalesce(a.i, 0) * coalesce(r.i, 0)), 4) AS dot, round(sum(coalesce(a.i, 0) * coalesce(r.i, 0)) / sqrt(sum(coalesce(a.i, 0) * coalesce(a.i, 0)) * sum(coalesce(r.i, 0) * coalesce(r.i, 0))), 6) AS cosine,
  count(*) FILTER (a.i > 0 AND r.i > 0) AS shared FROM (SELECT * FROM x WHERE f = 'A') a FULL JOIN (SELECT * FROM x WHERE f = 'R') r USING (l_suppkey, b) GROUP BY l_suppkey""")
def spectrum_similarity(t):
    x = t("lineitem").groupBy("l_suppkey", F.floor(F.col("l_extendedprice") / 5000).alias("b"), "l_returnflag").agg(F.sum("l_quantity").alias("i"))
    done = scoring.spectrum_similarity(x.where("l_returnflag = 'A'"), x.where("l_returnflag = 'R'"), ["l_suppkey"], "b", "i")
    return done.select("l_suppkey", F.round("dot", 4).alias("dot"), F.round("cosine", 6).alias("cosine"), "shared")


@query("error_likelihood", """SELECT event_id, round(-pow((value - 10) / 4.0, 2) / 2 - ln(4.0::DOUBLE) + pow((value - 20) / 12.0, 2) / 2 + ln(12.0::DOUBLE), 6) AS score FROM events""")
def error_likelihood(t):
    return t("events").select("event_id", F.round(scoring.error_likelihood(F.col("value"), (10.0, 4.0), (20.0, 12.0)), 6).alias("score"))


@query("rank_scores", """WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate) AS rank FROM lineitem)
SELECT l_orderkey, l_partkey, l_extendedprice, CASE WHEN rank <= 4 THEN round(ln((0.5 / rank) / (0.1 * rank)), 6) ELSE 0.0 END AS rank_score FROM r""")
def rank_scores(t):
    from spectroloom.operators.windows import intensity_ranks

    ranked = intensity_ranks(t("lineitem"), ["l_orderkey"], "l_extendedprice", ["l_partkey", "l_suppkey", "l_shipdate"]).withColumn("series", F.lit("y"))
    spark = ranked.sparkSession
    table = spark.range(1, 5).select(F.col("id").cast("int").alias("rank"), F.lit("y").alias("series"), (0.5 / F.col("id")).alias("target"), (F.lit(0.1) * F.col("id")).alias("decoy"))
    done = scoring.rank_score(ranked, table, ["series"], "rank")
    return done.select("l_orderkey", "l_partkey", "l_extendedprice", F.round("rank_score", 6).alias("rank_score"))


@query("score_cutoff", """SELECT l_suppkey, count(*) AS n_matched, round(count(*) + 0.5 * sum(log2(1 + l_quantity / 10)), 4) AS score FROM lineitem GROUP BY l_suppkey HAVING count(*) + 0.5 * sum(log2(1 + l_quantity / 10)) > 12""")
def score_cutoff(t):
    rows = t("lineitem").select("l_suppkey", F.col("l_quantity").alias("matched_intensity"), F.lit(0.0).alias("error_ppm"))
    done = scoring.composite_score(rows, ["l_suppkey"], {"count": 1.0, "intensity": 0.5}, F.lit(10.0)).where("score > 12")
    return done.select("l_suppkey", "n_matched", F.round("score", 4).alias("score"))


@query("feature_alignment_pairs", """WITH f AS (SELECT c_custkey AS id, c_nationkey % 3 AS run, c_acctbal + 1000 AS mass, (c_custkey % 100) / 100.0 AS net FROM customer)
SELECT a.id AS u, b.id AS v FROM f a JOIN f b ON a.run < b.run AND abs(a.mass - b.mass) <= a.mass * 500 / 1e6 AND abs(a.net - b.net) <= 0.03001""")
def feature_alignment_pairs(t):
    f = t("customer").select(F.col("c_custkey").alias("u"), (F.col("c_nationkey") % 3).alias("run"), (F.col("c_acctbal") + 1000).alias("mass"), (F.col("c_custkey") % 100 / 100.0).alias("net"))
    other = f.toDF("v", "run2", "mass2", "net2")
    return band_join(f, other, "mass", "mass2", 500, "ppm").where((F.col("run") < F.col("run2")) & (F.abs(F.col("net") - F.col("net2")) <= 0.03001)).select("u", "v")


@query("feature_alignment_groups")
def feature_alignment_groups(t):
    f = t("customer").select(F.col("c_custkey").alias("feature"), (F.col("c_nationkey") % 3).cast("string").alias("run"), (F.col("c_acctbal") + 1000).alias("mass"), (F.col("c_custkey") % 100 / 100.0).alias("net"), F.col("c_acctbal").alias("abundance"))
    return features.alignment_crosstab(features.aligned(f, 500, 0.03), ["0", "1", "2"])


@query("greedy_non_overlapping")
def greedy_non_overlapping(t):
    f = t("customer").select(F.col("c_custkey").alias("feature"), "c_nationkey", F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 200).alias("low"), (F.col("c_custkey") % 200 + 20).alias("high"))
    return graph.greedy_non_overlapping(f, "c_nationkey", "score", "low", "high", "feature").select("feature", "c_nationkey")


@query("averagine_envelopes")
def averagine_envelopes(t):
    e = t("part").select("p_partkey", numeric.envelope_of_mass(F.col("p_retailprice") * 10).alias("envelope"))
    return e.select("p_partkey", F.size("envelope").alias("n"), (F.array_position("envelope", F.array_max("envelope")) - 1).alias("most_abundant"))


@query("significance_tests")
def significance_tests(t):
    n = F.lit(200)
    return t("part").select("p_partkey", F.round(numeric.hypergeometric_udf(n, F.col("p_size"), F.lit(20), F.col("p_size") % 7), 9).alias("hypergeometric"), F.round(numeric.rank_sum_udf(n.cast("double"), F.lit(20.0), F.col("p_size") * 60.0), 9).alias("rank_sum"), F.round(numeric.poisson_udf(F.col("p_size") / 5.0, F.col("p_size") % 7), 9).alias("poisson"))


LOG_CHOOSE = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@query("hypergeometric_tests", f"""WITH x AS (SELECT DISTINCT p_size AS k, p_size % 7 AS k1 FROM part), s AS (SELECT k, k1, sum(exp({LOG_CHOOSE.format(n="k", k="x")} + {LOG_CHOOSE.format(n="(200 - k)", k="(20 - x)")} - {LOG_CHOOSE.format(n="200", k="20")})) AS c FROM x, range(0, 7) r(x) WHERE x <= k1 AND x <= k GROUP BY ALL)
SELECT p_partkey, round(1 - least(1.0, c), 9) AS p FROM part JOIN s ON k = p_size AND k1 = p_size % 7""")
def hypergeometric_tests(t):
    return t("part").select("p_partkey", F.round(numeric.hypergeometric_udf(F.lit(200), F.col("p_size"), F.lit(20), F.col("p_size") % 7), 9).alias("p"))


@query("poisson_tests", """WITH x AS (SELECT DISTINCT p_size, p_size / 5.0 AS mean, p_size % 7 AS k FROM part), s AS (SELECT p_size, sum(exp(x * ln(mean) - mean - lgamma(x + 1))) AS c FROM x, range(0, 7) r(x) WHERE x <= k GROUP BY ALL) SELECT p_partkey, round(greatest(0.0, 1 - c), 9) AS p FROM part JOIN s USING (p_size)""")
def poisson_tests(t):
    return t("part").select("p_partkey", F.round(numeric.poisson_udf(F.col("p_size") / 5.0, F.col("p_size") % 7), 9).alias("p"))


@query("generating_function_e_values")
def generating_function_e_values(t):
    rows = t("part").select("p_partkey", (F.col("p_size") * 20 + 300).cast("int").alias("target"), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct((i * 57).cast("int").alias("mass"), F.lit(1).alias("score"))).alias("nodes"), (F.col("p_size") % 5 + 1).cast("int").alias("score"))
    return scoring.generating_function(rows, ["p_partkey"], "target", "nodes", "score", {r: RESIDUE_MASS[r] for r in RESIDUES})


@query("suffix_array", f"""WITH {SEQ}, x AS (SELECT p_partkey, CAST(i AS BIGINT) AS start, substr(s, i) AS suffix FROM p, (SELECT unnest(range(1, (SELECT max(length(s)) FROM p) + 1)) AS i) WHERE i <= length(s)),
l AS (SELECT *, row_number() OVER o AS position, coalesce(lag(suffix) OVER o, '') AS b FROM x WINDOW o AS (ORDER BY suffix, p_partkey, start))
SELECT p_partkey, start, length(suffix) AS length, position, CAST(len(list_filter(range(1, least(length(suffix), length(b)) + 1), lambda i: substr(suffix, 1, CAST(i AS INT)) = substr(b, 1, CAST(i AS INT)))) AS BIGINT) AS common FROM l""")
def suffix_array(t):
    return suffixes.suffix_array(_proteins(t), "p_partkey", "sequence")


@query("distinct_substrings_by_length", f"""WITH {SEQ} SELECT length, count(DISTINCT substr(s, start, length)) AS substrings FROM (SELECT s, unnest(range(1, length(s) + 1)) AS start FROM p), LATERAL (SELECT unnest(range(1, length(s) - start + 2)) AS length) GROUP BY length""")
def distinct_substrings_by_length(t):
    return suffixes.distinct_substrings(suffixes.suffix_array(_proteins(t), "p_partkey", "sequence"))
