"""Queries over spectra that are made from the sample tables, so that SQL knows what must be found in them."""

from pyspark.sql import functions as F

from spectroloom.functions import numeric, text
from spectroloom.functions.mass import PROTON, RESIDUE_MASS, WATER, residue_mass
from spectroloom.operators import deconvolution, evidence, features, graph, joins, ranking, scoring, search, sequences, tags, training
from spectroloom.operators.scratch import shared_folder
from spectroloom.plans.registry import query
from spectroloom.sources import parameters, spectra, tables

MASS_SQL = "r(r, m) AS (VALUES " + ", ".join(f"('{r}', {m!r})" for r, m in RESIDUE_MASS.items()) + ")"
#: What is no residue stands for residues, each digit for one of its own mass.
LETTERS = ("BJOUXZ _0123456789", "DLKCWHFGACDEFGHKMN")


def _sequence(column):
    return F.translate(F.upper(column), *LETTERS)


def _sequence_sql(column: str) -> str:
    return f"translate(upper({column}), '{LETTERS[0]}', '{LETTERS[1]}')"


@query("feature_clusters", """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_nationkey % 2 AS run, c_custkey % 60 AS scan, c_acctbal + 2000 AS mass FROM customer),
e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.run = b.run AND a.id <> b.id AND b.scan - a.scan BETWEEN 0 AND 4 AND abs(a.mass - b.mass) <= a.mass * 400 / 1e6),
l AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT id, id AS c FROM p UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.id) SELECT id, min(c) AS least FROM r GROUP BY id""")
def feature_clusters(t):
    c = t("customer")
    p = c.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 2).alias("run"), (F.col("c_custkey") % 60).alias("scan_num"), (F.col("c_acctbal") + 2000).alias("mass"), F.lit(2).alias("charge"), F.lit(1.0).alias("intensity"))
    found = features.peak_clusters(p, ppm=400.0)
    return found.join(found.groupBy("feature").agg(F.min("id").alias("least")), "feature").select("id", "least")


@query("merged_feature_groups", """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_nationkey AS run, c_custkey % 100 / 100.0::DOUBLE AS net, c_acctbal + 2000 AS mass FROM customer),
e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.run = b.run AND a.id <> b.id AND abs(a.net - b.net) <= 0.105 AND abs(a.mass - b.mass) <= a.mass * 3000 / 1e6),
l AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT id, id AS c FROM p UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.id) SELECT id AS feature, min(c) AS component FROM r GROUP BY id""")
def merged_feature_groups(t):
    f = t("customer").select(F.col("c_custkey").alias("feature"), F.col("c_nationkey").alias("run"), (F.col("c_custkey") % 100 / 100.0).alias("net"), (F.col("c_acctbal") + 2000).alias("mass"))
    return features.merged_features(f, ppm=3000.0, net=0.105).select("feature", "component")


@query("aligned_runs", """SELECT c_custkey AS feature, run, c_custkey * 10 + 1000 AS group_mass FROM customer, (VALUES ('a'), ('b'), ('c')) v(run)""")
def aligned_runs(t):
    # three runs of features that are too far apart to be taken for each other: the 100 of nearest masses by their times
    c = t("customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    f = c.select(F.substring(F.lit("abc"), F.col("k") + 1, F.lit(1)).alias("run"), (F.col("c_custkey") * 4 + F.col("k")).alias("feature"), (F.col("c_custkey") * 10 + 1000 + F.col("k") * 0.001).alias("mass"), (F.col("c_custkey") % 100 * 0.025 + F.col("k") * 0.002).alias("net"))
    done = features.aligned(f, 5.0, 0.01)
    whole = done.groupBy("group_id").agg(F.min("mass").alias("least"))
    return done.join(whole, "group_id").select((F.col("feature") - F.col("feature") % 4).alias("f4"), "run", F.col("least").cast("long").alias("group_mass")).select((F.col("f4") / 4).cast("long").alias("feature"), "run", "group_mass")


@query("alignment_crosstab", """SELECT c_custkey * 10.0 + 1000 AS mass, c_acctbal AS a_Abundance, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal + 1 END AS b_Abundance FROM customer""")
def alignment_crosstab(t):
    c = t("customer")
    # the 42 of nearest masses are apart by their times; both runs have the last time
    start = F.col("c_custkey") % 42 * 3.0
    table = lambda k: c.select(F.col("c_custkey").cast("int").alias("FeatureID"), (F.col("c_custkey") * 10.0 + 1000).alias("MonoMass"), start.alias("MinElutionTime"), (start + 5.0).alias("MaxElutionTime"), (F.col("c_acctbal") + k).alias("Abundance"))
    done = search.align({"a": table(0), "b": table(1).where("FeatureID % 3 > 0")}, 5.0)
    return done.select(F.col("mass"), "a_Abundance", "b_Abundance")


@query("missing_cells", """WITH g AS (SELECT s_suppkey AS group_id, 'a' AS run, s_acctbal + 2000 AS mass, 0.3 AS net FROM supplier UNION ALL SELECT s_suppkey, 'b', s_acctbal + 2000, 0.4 FROM supplier WHERE s_suppkey % 2 = 0),
w AS (SELECT group_id, min(mass) AS mass, min(net) AS lo, max(net) AS hi FROM g GROUP BY 1), p AS (SELECT CASE WHEN c_nationkey < 12 THEN 'a' ELSE 'b' END AS run, c_acctbal + 2000 AS mass, c_custkey % 10 / 10.0 AS net, c_custkey AS intensity FROM customer)
SELECT group_id, 'b' AS run, CAST(sum(intensity) AS DOUBLE) AS abundance FROM w JOIN p ON p.run = 'b' AND abs(w.mass - p.mass) <= w.mass * 5000 / 1e6 AND p.net BETWEEN lo AND hi WHERE group_id NOT IN (SELECT group_id FROM g WHERE run = 'b') GROUP BY 1""")
def missing_cells(t):
    s, c = t("supplier"), t("customer")
    row = lambda run, net: (F.col("s_suppkey").alias("group_id"), F.lit(run).alias("run"), (F.col("s_acctbal") + 2000).alias("mass"), F.lit(net).alias("net"))
    g = s.select(*row("a", 0.3)).unionByName(s.where("s_suppkey % 2 = 0").select(*row("b", 0.4)))
    runs = s.sparkSession.createDataFrame([("a",), ("b",)], "run string")
    p = c.select(F.when(F.col("c_nationkey") < 12, "a").otherwise("b").alias("run"), (F.col("c_acctbal") + 2000).alias("mass"), (F.col("c_custkey") % 10 / 10.0).alias("net"), F.col("c_custkey").cast("double").alias("intensity"))
    return features.missing_cells(g, runs, p, 5000.0).select("group_id", "run", "abundance")


@query("mass_to_scans", """WITH f AS (SELECT c_acctbal + 2000 AS fm, c_nationkey * 10 AS lo, c_nationkey * 10 + 60 AS hi FROM customer), s AS (SELECT s_suppkey AS scan_num, 400 + s_suppkey % 7 * 150 AS low_mz FROM supplier)
SELECT DISTINCT p_partkey AS mass_id, scan_num FROM part JOIN f ON abs(p_retailprice * 4 - fm) <= p_retailprice * 4 * 60 / 1e6 JOIN s ON scan_num BETWEEN lo AND hi, range(2, 9) q(z) WHERE fm / z + 1.00727649 >= low_mz AND fm / z + 1.00727649 < low_mz + 40""")
def mass_to_scans(t):
    m = t("part").select(F.col("p_partkey").alias("mass_id"), (F.col("p_retailprice") * 4).alias("mass"))
    f = t("customer").select((F.col("c_acctbal") + 2000).alias("mass"), (F.col("c_nationkey") * 10).alias("min_scan"), (F.col("c_nationkey") * 10 + 60).alias("max_scan"), F.lit(2).alias("min_charge"), F.lit(8).alias("max_charge"))
    low = 400 + F.col("s_suppkey") % 7 * 150
    return features.mass_to_scans(m, f, t("supplier").select(F.col("s_suppkey").alias("scan_num"), low.alias("low_mz"), (low + 40).alias("high_mz")), 60.0)


@query("features_with_matches", """WITH h AS (SELECT s_suppkey, c_custkey, c_name FROM supplier JOIN customer ON abs(s_acctbal + 2000 - c_acctbal - 2000) < (s_acctbal + 2000) * 2000 / 1e6 AND s_nationkey < c_nationkey AND c_nationkey < s_nationkey + 9)
SELECT s_suppkey AS feature, arg_max(c_name, c_custkey) AS sequence, max(c_custkey) AS score, CASE WHEN count(c_custkey) > 0 THEN count(c_custkey) END AS n_matches FROM supplier LEFT JOIN h USING (s_suppkey) GROUP BY 1""")
def features_with_matches(t):
    # differences are rounded as in the SQL, which decides at the very edge
    apart = F.abs(F.col("s_acctbal") + 2000 - F.col("c_acctbal") - 2000)
    f = t("supplier").select("s_acctbal", F.col("s_suppkey").alias("feature"), (F.col("s_acctbal") + 2000).alias("mass"), F.col("s_nationkey").alias("min_scan"), (F.col("s_nationkey") + 9).alias("max_scan"))
    m = t("customer").select("c_acctbal", (F.col("c_acctbal") + 2000).alias("mass"), F.col("c_nationkey").alias("scan"), F.col("c_name").alias("sequence"), F.col("c_custkey").alias("score"))
    return features.features_with_matches(f, m, 2000.0, apart, ["c_acctbal"]).select("feature", "sequence", "score", "n_matches")


@query("isotope_peaks", """WITH i AS (SELECT o_orderkey, o_totalprice / 4 AS mass FROM orders), e AS (SELECT o_orderkey, k, (mass + k * 1.00335483) / 2 + 1.00727649 AS mz FROM i, range(0, 3) q(k)),
h AS (SELECT o_orderkey, k, max(l_quantity) AS x FROM e JOIN lineitem ON l_orderkey = o_orderkey AND abs(mz - l_extendedprice) <= mz * 60000 / 1e6 GROUP BY ALL)
SELECT o_orderkey, coalesce(max(x) FILTER (k = 0), 0.0) AS a, max(x) FILTER (k = 1) AS b, coalesce(max(x) FILTER (k = 2), 0.0) AS c FROM h GROUP BY 1 HAVING count(*) FILTER (k = 1) > 0""")
def isotope_peaks(t):
    ions = t("orders").select("o_orderkey", F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 4).alias("ion_mass"), F.lit(2).alias("charge"), F.array(F.lit(0.6), F.lit(1.0), F.lit(0.4)).alias("envelope"))
    done = deconvolution.isotope_peaks(ions, t("lineitem"), ["o_orderkey"], 60000.0, ["l_orderkey"], "l_extendedprice", "l_quantity")
    return done.select("o_orderkey", *[F.get("observed", k).alias(n) for k, n in enumerate("abc")])


@query("nearest_deconvoluted_mass", """SELECT s_suppkey, arg_min(c_custkey, (abs(c_acctbal - s_acctbal), c_acctbal, c_custkey)) AS c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal + 2000 - c_acctbal - 2000) <= (s_acctbal + 2000) * 20000 / 1e6 GROUP BY 1""")
def nearest_deconvoluted_mass(t):
    # differences are rounded as in the SQL, which decides between peaks as near on either side
    apart, gap = F.abs(F.col("s_acctbal") + 2000 - F.col("c_acctbal") - 2000), F.abs(F.col("c_acctbal") - F.col("s_acctbal"))
    targets = t("supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("k"), (F.col("s_acctbal") + 2000).alias("target"))
    peaks = t("customer").select("c_acctbal", F.col("c_nationkey").alias("k"), (F.col("c_acctbal") + 2000).alias("mass"), F.col("c_custkey").alias("charge"), F.lit(1.0).alias("intensity"))
    return deconvolution.nearest_mass(targets, peaks, "target", ["s_suppkey"], 20000.0, ["k"], apart, gap).select("s_suppkey", F.col("charge").alias("c_custkey"))


@query("ms1_evidence", """SELECT o_orderkey, coalesce((SELECT max(l_discount) FROM lineitem WHERE l_partkey % 50 = o_custkey % 50 AND l_suppkey BETWEEN o_orderkey % 40 - 3 AND o_orderkey % 40 + 3), 0.0) AS ms1_corr FROM orders""")
def ms1_evidence(t):
    matches = t("orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("mass_id"), (F.col("o_orderkey") % 40).alias("scan"))
    matrix = t("lineitem").groupBy((F.col("l_partkey") % 50).alias("mass_id"), F.col("l_suppkey").alias("scan_num")).agg(F.max("l_discount").alias("corr"))
    return evidence.ms1_evidence(matches, matrix, ["o_orderkey"], "scan", 3).select("o_orderkey", "ms1_corr")


@query("mass_error_histogram", """WITH g AS (SELECT l_linenumber AS cut, lead(l_linenumber) OVER w AS next, lead(l_extendedprice) OVER w - l_extendedprice - (lead(l_quantity) OVER w * 1500 - l_quantity * 1500) AS e FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) = 1) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT CASE WHEN e < -25000 THEN 0 WHEN e >= 25000 THEN 11 ELSE 1 + CAST(floor((e + 25000) / 5000) AS BIGINT) END AS bin, count(*) AS n FROM g WHERE next = cut + 1 GROUP BY 1""")
def mass_error_histogram(t):
    from spectroloom.operators.windows import best_per

    li = best_per(t("lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_extendedprice")]).withColumn("expected", F.col("l_quantity") * 1500)
    return training.mass_error_table(li, ["l_orderkey"], "l_linenumber", "l_extendedprice", "expected", 5000.0, 10).select(F.col("bin").cast("long").alias("bin"), "n")


@query("gaussian_smoothing", """WITH e AS (SELECT user_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT a.user_id, a.event_id, round(CASE WHEN a.n < 7 THEN a.value ELSE (SELECT sum(b.value * exp(-0.5 * (a.i - b.i) * (a.i - b.i))) / sum(exp(-0.5 * (a.i - b.i) * (a.i - b.i))) FROM e b WHERE b.user_id = a.user_id AND abs(a.i - b.i) <= 3) END, 6) AS smoothed FROM e a""")
def gaussian_smoothing(t):
    rows = t("events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("e"))
    each = rows.select("user_id", F.explode(F.arrays_zip(F.col("e.event_id").alias("id"), numeric.gaussian_udf(F.col("e.value")).alias("s"))).alias("x"))
    return each.select("user_id", F.col("x.id").alias("event_id"), F.round("x.s", 6).alias("smoothed"))


@query("histogram_noise", """WITH e AS (SELECT user_id, event_id, ln(value + 1) AS y FROM events), m AS (SELECT user_id, min(y) AS lo, max(y) AS hi FROM e GROUP BY 1),
b AS (SELECT e.*, lo, hi, CASE WHEN hi = lo THEN 0 ELSE least(9, CAST(floor((y - lo) / ((hi - lo) / 10)) AS INT)) END AS bin FROM e JOIN m USING (user_id)),
c AS (SELECT user_id, bin, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT user_id, arg_max(bin, (n, -bin)) AS mode FROM c GROUP BY 1)
SELECT b.user_id, count(*) AS n FROM b JOIN t USING (user_id) WHERE hi = lo OR mode = 9 OR bin > mode GROUP BY 1""")
def histogram_noise(t):
    rows = t("events").groupBy("user_id").agg(F.collect_list(F.col("value") + 1).alias("y"))
    kept = rows.select("user_id", F.size(F.filter(numeric.histogram_noise_udf(F.col("y"), F.col("y")), lambda k: k)).cast("long").alias("n"))
    return kept.where("n > 0")


@query("vendor_noise", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice >= 1.5 * l_quantity * 900""")
def vendor_noise(t):
    return evidence.above_noise(t("lineitem").withColumn("noise", F.col("l_quantity") * 900), "l_extendedprice", "noise", 1.5).select("l_orderkey", "l_linenumber", "l_partkey")


@query("good_target_rows", """SELECT p_partkey FROM part WHERE p_size <= 20 AND p_partkey % 3 <> 0 AND p_retailprice >= 1000""")
def good_target_rows(t):
    from spectroloom.operators.filters import above, without_decoys

    named = t("part").where("p_size <= 20").withColumn("protein", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("XXX_"), "p_name")).otherwise(F.col("p_name")))
    return above(without_decoys(named, "protein"), "p_retailprice", 1000).select("p_partkey")


@query("annotations", """SELECT p_partkey, 'K.' || p_name || '.R' AS annotation, upper(sha1(p_name)) AS digest FROM part""")
def annotations(t):
    return t("part").select("p_partkey", text.annotation(F.lit("K"), F.col("p_name"), F.lit("R")).alias("annotation"), text.sha1_upper(F.col("p_name")).alias("digest"))


@query("quick_counts_of_customers", f"""WITH {MASS_SQL}, p AS (SELECT min(n_nationkey) AS k, {_sequence_sql("n_name")} AS s FROM nation GROUP BY 2), l AS (SELECT k, s, i, coalesce(m, 0) AS m FROM (SELECT k, s, i, substr(s, i, 1) AS x FROM p, range(1, 60) q(i) WHERE i <= length(s)) LEFT JOIN r ON r = x),
b AS (SELECT DISTINCT k, CAST(round_even(mass * 0.9995, 0) AS BIGINT) AS bin FROM (SELECT k, i, length(s) AS n, sum(m) OVER (PARTITION BY k ORDER BY i) AS mass FROM l) WHERE i < n),
h AS (SELECT c, k, count(*) AS n_bins FROM (SELECT DISTINCT c_nationkey AS c, CAST(round_even(c_acctbal / 8 * 0.9995, 0) AS BIGINT) AS bin FROM customer) JOIN b USING (bin) GROUP BY ALL)
SELECT c, arg_min(k, (-n_bins, k)) AS k, max(n_bins) AS n_bins FROM h GROUP BY 1""")
def quick_counts_of_customers(t):
    p = t("nation").select(F.col("n_nationkey").alias("k"), _sequence("n_name").alias("sequence"))
    return evidence.quick_counts(p, t("customer").select(F.col("c_nationkey").alias("c"), (F.col("c_acctbal") / 8).alias("mass")), "k", "sequence", "c", "mass")


@query("looked_up_likelihood", """WITH s AS (SELECT n_nationkey AS bin, n_nationkey / 8.0 AS score FROM nation WHERE n_nationkey < 20) SELECT c_custkey AS feature_id, coalesce(a.score, 0) + coalesce(b.score, 0) AS likelihood FROM customer LEFT JOIN s a ON a.bin = c_nationkey LEFT JOIN s b ON b.bin = c_custkey % 25""")
def looked_up_likelihood(t):
    table = t("nation").where("n_nationkey < 20").select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("name"), F.lit(0).alias("k"), F.col("n_nationkey").alias("bin"), (F.col("n_nationkey") / 8.0).alias("score"))
    bins = F.array(F.struct(F.lit("x").alias("name"), F.col("c_nationkey").cast("long").alias("bin")), F.struct(F.lit("y").alias("name"), (F.col("c_custkey") % 25).cast("long").alias("bin")))
    f = t("customer").select(F.col("c_custkey").alias("feature_id"), F.lit(0).alias("k"), bins.alias("bins"))
    return scoring.table_likelihood(f, table, ["k"]).select("feature_id", "likelihood")


@query("merged_tag_spans", """WITH h AS (SELECT l_orderkey % 40 AS k, l_suppkey AS lo, l_suppkey + 3 AS hi FROM lineitem), g AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS s FROM h),
u AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT k, min(lo) AS low, max(hi) AS high, count(*) AS n FROM u GROUP BY k, run""")
def merged_tag_spans(t):
    h = t("lineitem").select((F.col("l_orderkey") % 40).alias("k"), F.col("l_suppkey").alias("position"), F.lit("ABCD").alias("tag"))
    return tags.merged_tags(h, ["k"], "position", "tag").select("k", "low", "high", "n")


@query("position_in_protein", f"""WITH {MASS_SQL}, p AS (SELECT n_nationkey AS k, {_sequence_sql("n_name || r_name")} AS s FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT k, 1 AS start, length(s) AS stop, substr(s, 2) AS matched FROM p""")
def position_in_protein(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = n.select(F.col("n_nationkey").alias("k"), _sequence(F.concat("n_name", "r_name")).alias("sequence"))
    # tags of three residues from the third on, with the masses that lead from the second residue to the end
    h = p.select("k", F.lit(2).alias("position"), F.substring("sequence", 3, 3).alias("tag"), residue_mass(F.substring("sequence", 2, 1)).alias("before"), residue_mass(F.substring(F.col("sequence"), F.lit(6), F.length("sequence"))).alias("after"))
    done = evidence.extended_tags(h, p, "k", "sequence", "position", "tag", "before", "after", 1e-6)
    return done.select("k", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "matched")


def _proteins(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.concat(F.lit("N"), "n_nationkey").alias("name"), F.lit("").alias("description"), _sequence(F.concat("n_name", "r_name")).alias("sequence"))


def _planted(t, shift: float, series=("b", "y"), activation: str = "CID"):
    """A fragment spectrum for each supplier, of its nation's sequence; with ``shift`` every second one has it on its last
    M or W, if there is one. Precursor, activation and deconvoluted peaks."""
    p = _proteins(t).withColumn("at", F.length("sequence") - F.locate("M", F.reverse(F.translate("sequence", "W", "M"))) + 1).withColumn("at", F.when(F.col("sequence").rlike("[MW]"), F.col("at")).otherwise(0))
    s = t("supplier").join(p, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("put", F.when((F.col("s_suppkey") % 2 == 1) & (F.col("at") > 0), F.lit(shift)).otherwise(F.lit(0.0)))
    whole = residue_mass(F.col("sequence")) + WATER + F.col("put")
    scans = s.select(F.col("s_suppkey").cast("int").alias("scan_num"), F.lit(2).alias("ms_level"), F.struct((whole / 2 + PROTON).alias("mono_mz"), F.lit(2).alias("charge")).alias("isolation"), F.lit(activation).alias("activation"))
    ions = sequences.fragments(s.select("s_suppkey", "sequence", "at", "put"), "sequence", series)
    carries = F.when(F.col("ion").isin("a", "b", "c"), F.col("cut") >= F.col("at")).otherwise(F.col("cut") > F.length("sequence") - F.col("at"))
    peaks = ions.select(F.col("s_suppkey").cast("int").alias("scan_num"), (F.col("fragment_mass") + F.when(carries, F.col("put")).otherwise(0.0)).alias("mass"), F.lit(10.0).alias("intensity"))
    return scans, peaks


FOUND = f"""WITH p AS (SELECT n_nationkey, {_sequence_sql("n_name || r_name")} AS s FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT CAST(s_suppkey AS INT) AS scan_num, s AS sequence"""
OPTIONS = dict(min_length=6, max_length=60, min_mass=300.0, max_mass=9000.0, cleavage="none", keep=3, report=1)


@query("search_plain", f"""{FOUND}, 2 * (length(s) - 1) AS n_matched FROM supplier JOIN p ON s_nationkey = n_nationkey""")
def search_plain(t):
    scans, peaks = _planted(t, 0.0)
    done = search.search(scans, _proteins(t), None, parameters.SearchParameters(**OPTIONS), peaks)
    return done.where("NOT is_decoy").select("scan_num", "sequence", "n_matched")


@query("search_by_electron_transfer", f"""{FOUND}, 2 * (length(s) - 1) AS n_matched FROM supplier JOIN p ON s_nationkey = n_nationkey""")
def search_by_electron_transfer(t):
    scans, peaks = _planted(t, 0.0, ("c", "z"), "ETD")
    done = search.search(scans, _proteins(t), None, parameters.SearchParameters(**OPTIONS), peaks)
    return done.where("NOT is_decoy").select("scan_num", "sequence", "n_matched")


@query("search_modified", f"""{FOUND}, CASE WHEN s_suppkey % 2 = 1 AND regexp_matches(s, '[MW]') THEN length(s) - strpos(reverse(translate(s, 'W', 'M')), 'M') + 1 ELSE 0 END AS placed, 2 * (length(s) - 1) AS n_matched FROM supplier JOIN p ON s_nationkey = n_nationkey""")
def search_modified(t):
    scans, peaks = _planted(t, 15.994915)
    done = search.search(scans, _proteins(t), {"Ox": (15.994915, "MW")}, parameters.SearchParameters(**OPTIONS, max_modifications=2), peaks)
    return done.where("NOT is_decoy").select("scan_num", "sequence", F.array_position("placement", "Ox").alias("placed"), "n_matched")


@query("rescored_matches", f"""{FOUND}, 2 * (length(s) - 1) AS n_matched FROM supplier JOIN p ON s_nationkey = n_nationkey""")
def rescored_matches(t):
    _, peaks = _planted(t, 0.0)
    results = t("supplier").join(_proteins(t), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("int").alias("Scan"), F.col("sequence").alias("Sequence"))
    return search.rescore(results, peaks).select(F.col("Scan").alias("scan_num"), F.col("Sequence").alias("sequence"), "n_matched")


@query("fdr_of_result_files", """WITH r AS (SELECT p_partkey AS scan, p_name AS seq, p_retailprice AS e, p_partkey % 4 = 0 AS d FROM part),
c AS (SELECT *, sum(d::INT) OVER w AS nd, sum((NOT d)::INT) OVER w AS nt FROM r WINDOW w AS (ORDER BY e, d DESC, seq, scan ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, CASE WHEN nt > 0 THEN least(1.0, nd / nt) ELSE 1.0 END AS fdr FROM c)
SELECT CAST(scan AS INT) AS Scan, round(min(fdr) OVER (ORDER BY e, d DESC, seq, scan ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS QValue FROM f""")
def fdr_of_result_files(t):
    p = t("part")
    spark, paths = p.sparkSession, []
    for decoy in (False, True):
        own = p.where((F.col("p_partkey") % 4 == 0) == F.lit(decoy))
        rows = own.select(F.col("p_partkey").alias("Scan"), F.lit("K").alias("Pre"), F.col("p_name").alias("Sequence"), F.lit("R").alias("Post"), F.concat(F.lit("XXX_" if decoy else "P"), "p_partkey").alias("ProteinName"), F.col("p_partkey").alias("Start"), F.lit(0.5).alias("Probability"), F.col("p_retailprice").alias("EValue"))
        paths.append(f"{shared_folder(spark)}/x.tsv")
        rows.write.option("header", True).option("sep", "\t").csv(paths[-1])
    return search.fdr_of_files(spark, *paths).select("Scan", F.round("QValue", 9).alias("QValue"))


def _envelope_spectra(t, scans: int):
    """Spectra with the isotopes of one mass for each nation at charges 5 to 7, more abundant in the middle of ``scans`` scans."""
    iso = numeric.envelope_of_mass(F.col("mass"))
    n = t("nation").withColumn("mass", F.lit(5000.0) + F.col("n_nationkey") * 137.0).withColumn("envelope", iso).withColumn("scan_num", F.explode(F.sequence(F.lit(1), F.lit(scans))))
    height = (F.lit(scans) - F.abs(F.col("scan_num") * 2 - scans - 1) + 1) * 1000.0
    peaks = n.withColumn("z", F.explode(F.sequence(F.lit(5), F.lit(7)))).select("n_nationkey", "scan_num", height.alias("h"), "z", "mass", F.posexplode("envelope").alias("k", "r"))
    lists = F.sort_array(F.collect_list(F.struct(((F.col("mass") + F.col("k") * 1.00335483) / F.col("z") + PROTON).alias("mz"), (F.col("h") * F.col("r")).alias("i"))))
    return peaks.groupBy("n_nationkey", "scan_num").agg(lists.alias("p")).select(F.concat(F.lit("run"), "n_nationkey").alias("run"), "n_nationkey", "scan_num", F.lit(1).alias("ms_level"), (F.col("scan_num") / 10).alias("elution_time"), F.col("p.mz").alias("mz"), F.col("p.i").alias("intensity"))


@query("deconvoluted_spectra", """SELECT n_nationkey, CAST(scan_num AS INT) AS scan_num, CAST(z AS INT) AS charge, CAST(5000 + n_nationkey * 137 AS BIGINT) AS mass FROM nation, range(1, 4) s(scan_num), range(5, 8) q(z)""")
def deconvoluted_spectra(t):
    s = _envelope_spectra(t, 3)
    found = deconvolution.deconvolute(s, ["n_nationkey", "scan_num"], (3, 10))
    wanted = F.col("mass") - (F.lit(5000.0) + F.col("n_nationkey") * 137.0)
    return found.where((F.abs(wanted) < 0.02) & (F.col("corr") > 0.9)).select("n_nationkey", "scan_num", "charge", F.bround("mass").cast("long").alias("mass")).distinct()


@query("found_features", """SELECT n_nationkey, 1 AS min_scan, 9 AS max_scan, 5 AS min_charge, 7 AS max_charge, 5 AS rep_scan FROM nation""")
def found_features(t):
    found = search.find_features(_envelope_spectra(t, 9), (3, 10))
    at = F.regexp_extract("run", "([0-9]+)", 1).cast("long")
    near = found.withColumn("n_nationkey", at).where(F.abs(F.col("mass") - 5000.0 - F.col("n_nationkey") * 137.0) < 0.05)
    best = ranking.top_k(near, ["n_nationkey"], [F.desc("abundance"), F.col("feature")], 1)
    return best.select("n_nationkey", "min_scan", "max_scan", "min_charge", "max_charge", "rep_scan")


def _feature_runs(t):
    """MS1 spectra of runs of seven parts each, whose m/z are apart: every part is a mass that elutes for 5 to 8 spectra at
    charges 6 to 8; every eleventh one comes a second time, weaker, behind a spectrum in which it is hardly there."""
    k = F.col("p_partkey")
    p = t("part").select(F.floor(k / 7).alias("run"), (3500.0 * F.pow(F.lit(1.2), k % 7) + F.col("p_size") * 0.7).alias("mass"), "p_retailprice", (1 + k % 5).alias("first"), (5 + k % 4).alias("long"), (k % 11 == 0).alias("twice"))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("twice"), 2 * F.col("long")).otherwise(F.col("long") - 1))))
    shape = F.col("long") + 1 - F.abs(2 * (F.col("k") % (F.col("long") + 1)) - F.col("long") + 1)
    height = F.when(F.col("k") == F.col("long"), 0.2).when(F.col("k") > F.col("long"), 0.8 * shape).otherwise(shape) * F.col("p_retailprice")
    p = p.withColumn("height", height).withColumn("envelope", numeric.envelope_of_mass(F.col("mass"))).withColumn("charge", F.explode(F.sequence(F.lit(6), F.lit(8))))
    peaks = p.select("run", (F.col("first") + F.col("k")).alias("scan_num"), "height", "charge", "mass", F.posexplode("envelope").alias("i", "r"))
    lists = F.sort_array(F.collect_list(F.struct(((F.col("mass") + F.col("i") * 1.00335483) / F.col("charge") + PROTON).alias("mz"), (F.col("height") * F.col("r")).alias("intensity"))))
    return peaks.groupBy("run", "scan_num").agg(lists.alias("p")).select("run", "scan_num", F.lit(1).alias("ms_level"), (F.col("scan_num") * 0.5).alias("elution_time"), "p.mz", "p.intensity")


@query("feature_table_of_runs", """WITH p AS (SELECT p_partkey // 7 AS run, CAST(round(10 * (3500.0 * pow(1.2, p_partkey % 7) + p_size * 0.7)) AS BIGINT) AS tenths, 1 + p_partkey % 5 AS f, 5 + p_partkey % 4 AS n, p_partkey FROM part)
SELECT run, tenths, CAST(f + s * (n + 1) AS INT) AS min_scan, CAST(f + s * (n + 1) + n - 1 AS INT) AS max_scan, 6 AS min_charge, 8 AS max_charge, CAST(3 * n AS INT) AS cells, CAST((f + s * (n + 1) + (n - 1) // 2) * 0.5 AS DOUBLE) AS apex_time FROM p, range(0, 2) q(s) WHERE s = 0 OR p_partkey % 11 = 0""")
def feature_table_of_runs(t):
    # the whole table that is found; the first of two equal middle spectra is the apex
    found = search.find_features(_feature_runs(t), (2, 12))
    return found.select("run", F.bround(10 * F.col("mass")).cast("long").alias("tenths"), F.col("min_scan").cast("int").alias("min_scan"), F.col("max_scan").cast("int").alias("max_scan"), "min_charge", "max_charge", F.col("n").alias("cells"), (F.col("rep_scan") * 0.5).alias("apex_time"))


def _matrix(t):
    s = _envelope_spectra(t, 9)
    masses = t("nation").select(F.col("n_nationkey").alias("mass_id"), (F.lit(5000.0) + F.col("n_nationkey") * 137.0).alias("mass")).withColumn("envelope", numeric.envelope_of_mass(F.col("mass")))
    return masses, evidence.feature_matrix(masses, spectra.exploded_peaks(s, "run", "scan_num"), (5, 7), 5.0)


@query("feature_matrix_cells", """SELECT n_nationkey AS mass_id, CAST(s AS INT) AS scan_num, CAST(z AS INT) AS charge FROM nation, range(1, 10) a(s), range(5, 8) b(z)""")
def feature_matrix_cells(t):
    _, m = _matrix(t)
    return m.where((F.col("run") == F.concat(F.lit("run"), "mass_id")) & (F.col("corr") > 0.99) & (F.col("dist") < 0.01)).select("mass_id", "scan_num", "charge")


@query("grown_clusters", """SELECT n_nationkey AS mass_id, 1 AS min_scan, 9 AS max_scan, 5 AS min_charge, 7 AS max_charge, 27 AS n_cells FROM nation""")
def grown_clusters(t):
    masses, m = _matrix(t)
    own = m.where(F.col("run") == F.concat(F.lit("run"), "mass_id"))
    return evidence.grow_clusters(own, masses).where("cluster = 0").select("mass_id", F.col("min_scan").cast("int").alias("min_scan"), F.col("max_scan").cast("int").alias("max_scan"), "min_charge", "max_charge", "n_cells")


@query("smoothed_apexes", """SELECT n_nationkey AS mass_id, 5 AS apex FROM nation""")
def smoothed_apexes(t):
    masses, m = _matrix(t)
    points = m.where((F.col("run") == F.concat(F.lit("run"), "mass_id")) & (F.col("charge") == 5)).select("mass_id", "scan_num", "abundance", F.lit(2).alias("from_scan"))
    return evidence.apexes(points, ["mass_id"], "scan_num", "abundance", "from_scan").select("mass_id", F.col("apex").cast("int").alias("apex"))


@query("ingested_run", """SELECT CAST(o_orderkey AS INT) AS scan_num, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey >= 100 GROUP BY 1""")
def ingested_run(t):
    line = F.concat(F.lit("BEGIN IONS\nSCANS="), "l_orderkey", F.lit("\n"), F.array_join(F.collect_list(F.concat(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit(" "), F.col("l_quantity").cast("string"))), "\n"), F.lit("\nEND IONS"))
    li = t("lineitem")
    path = f"{shared_folder(li.sparkSession)}/x.mgf"
    li.groupBy("l_orderkey").agg(line.alias("value")).select("value").write.text(path)
    out = shared_folder(li.sparkSession)
    mgf = spectra.read_mgf(li.sparkSession, path).withColumn("ms_level", F.lit(2)).where("scan_num >= 100")
    spectra.write_run(mgf, out)
    return spectra.read_run(li.sparkSession, out).select("scan_num", F.size("mz").cast("long").alias("n"))


@query("feature_map", """SELECT CAST(floor((c_acctbal + 1000) / 500) AS BIGINT) AS mass_bin, CAST(floor(c_nationkey / 5.0) AS BIGINT) AS time_bin, round(log10(sum(c_custkey)), 6) AS log_abundance FROM customer GROUP BY ALL""")
def feature_map(t):
    f = t("customer").select((F.col("c_acctbal") + 1000).alias("mass"), F.col("c_nationkey").cast("double").alias("time"), F.col("c_custkey").cast("double").alias("abundance"))
    return training.feature_map(f, "mass", "time", "abundance", 500.0, 5.0).withColumn("log_abundance", F.round("log_abundance", 6))


@query("log_ratio_table", """WITH c AS (SELECT l_returnflag AS f, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT f, k, n / sum(n) OVER (PARTITION BY f) AS p FROM c)
SELECT k, round(ln(coalesce(a.p, 0) / b.p), 9) AS score FROM (SELECT * FROM p WHERE f = 'A') a JOIN (SELECT * FROM p WHERE f = 'R') b USING (k)""")
def log_ratio_table(t):
    c = t("lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n"))
    p = training.probabilities(c, ["l_returnflag"])
    return training.log_ratio(p.where("l_returnflag = 'A'"), p.where("l_returnflag = 'R'"), ["k"]).where("target > 0 AND decoy > 0").select("k", F.round("score", 9).alias("score"))


@query("linear_scores", """SELECT p_partkey, round(0.5 + p_size * 0.125 - p_retailprice * 0.001, 9) AS raw_score, round(1 / (1 + exp(-(0.5 + p_size * 0.125 - p_retailprice * 0.001))), 9) AS probability FROM part""")
def linear_scores(t):
    done = training.linear_score(t("part"), {"p_size": 0.125, "p_retailprice": -0.001}, 0.5)
    return done.select("p_partkey", F.round("raw_score", 9).alias("raw_score"), F.round("probability", 9).alias("probability"))


@query("envelope_scores", """WITH e AS (SELECT l_orderkey, list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_extendedprice) AS a, list(l_quantity ORDER BY l_linenumber, l_partkey, l_extendedprice) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(list_cosine_similarity(a, b), 9) AS cosine FROM e""")
def envelope_scores(t):
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")))
    e = t("lineitem").groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.col("r.l_extendedprice").alias("envelope"), F.col("r.l_quantity").alias("observed"))
    return training.ion_scores(e).select("l_orderkey", F.round("cosine", 9).alias("cosine"))


@query("strongest_peaks_considered", """SELECT l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 3""")
def strongest_peaks_considered(t):
    return ranking.top_k(t("lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 3).select("l_orderkey", "l_extendedprice")


@query("match_limit", """SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100""")
def match_limit(t):
    return t("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select("p_partkey")


@query("overlapping_features_removed", """SELECT c_custkey AS feature FROM customer""")
def overlapping_features_removed(t):
    # each feature has a worse one at its mass and scans, which goes; the 100 of nearest masses are apart by their scans
    c = t("customer").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "c_custkey")
    f = c.select(F.lit("r").alias("run"), (F.col("c_custkey") + F.col("k") * 10**9).alias("feature"), (F.col("c_custkey") * 10.0 + 1000 + F.col("k") * 0.001).alias("mass"), (F.col("c_custkey") % 100 * 10 + 5 + F.col("k") * 3).cast("int").alias("min_scan"), (F.col("c_custkey") % 100 * 10 + 9 + F.col("k") * 3).cast("int").alias("max_scan"), (F.lit(2.0) - F.col("k")).alias("abundance"))
    return features.without_overlaps(f, 5.0).select("feature")


@query("tag_search", f"""{FOUND}, 2 * (length(s) - 1) AS n_matched FROM supplier JOIN p ON s_nationkey = n_nationkey""")
def tag_search(t):
    scans, peaks = _planted(t, 0.0)
    masses = scans.select("scan_num", ((F.col("isolation.mono_mz") - PROTON) * 2).alias("precursor_mass"))
    return search.tag_search(masses, peaks, _proteins(t), 4, 4).select("scan_num", "sequence", "n_matched").distinct()


@query("tag_search_of_shifted", f"""{FOUND}, 2 * (length(s) - 1) AS n_matched, CASE WHEN s_suppkey % 2 = 1 THEN 100 + s_suppkey % 50 * 1.25 ELSE 0.0 END::DOUBLE AS left_shift, 0.0::DOUBLE AS right_shift FROM supplier JOIN p ON s_nationkey = n_nationkey""")
def tag_search_of_shifted(t):
    # every second spectrum has a mass on its first residue that the search does not know
    put = F.when(F.col("scan_num") % 2 == 1, 100 + F.col("scan_num") % 50 * 1.25).otherwise(0.0)
    s = t("supplier").join(_proteins(t), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("int").alias("scan_num"), "sequence")
    masses = s.select("scan_num", (residue_mass(F.col("sequence")) + WATER + put).alias("precursor_mass"))
    ions = sequences.fragments(s, "sequence", ("b", "y"))
    peaks = ions.select("scan_num", (F.col("fragment_mass") + F.when(F.col("ion") == "b", put).otherwise(0.0)).alias("mass"), F.lit(10.0).alias("intensity"))
    done = search.tag_search(masses, peaks, _proteins(t), 4, 4, unknown=(-60.0, 400.0))
    best = ranking.top_k(done, ["scan_num"], [F.desc("score"), F.col("name"), F.col("start")], 1)
    return best.select("scan_num", "sequence", "n_matched", F.round("left_shift", 3).alias("left_shift"), F.round("right_shift", 3).alias("right_shift"))


@query("tag_search_of_features", f"""{FOUND}, s_nationkey AS feature FROM supplier JOIN p ON s_nationkey = n_nationkey WHERE s_suppkey <= (SELECT max(s_suppkey) * 2 // 5 FROM supplier)""")
def tag_search_of_features(t):
    scans, peaks = _planted(t, 0.0)
    masses = scans.select("scan_num", ((F.col("isolation.mono_mz") - PROTON) * 2).alias("precursor_mass"))
    # the feature of a nation's mass covers two fifths of the scans
    last = t("supplier").agg(F.floor(F.max("s_suppkey") * 2 / 5).alias("max_scan"))
    n = _proteins(t).join(F.broadcast(last)).select(F.col("n_nationkey").alias("feature"), (residue_mass(F.col("sequence")) + WATER).alias("mass"), F.lit(0).alias("min_scan"), "max_scan")
    done = search.feature_tag_search(n, masses, peaks, _proteins(t), least=4, most=4)
    return done.join(_proteins(t).select(F.col("n_nationkey").alias("feature"), F.col("sequence").alias("own")), "feature").where("sequence = own").select("scan_num", "sequence", "feature").distinct()


PRECURSORS = """w AS (SELECT o_orderkey AS scan_num, o_totalprice / 4 - 15000 AS lo, o_totalprice / 4 + 15000 AS hi FROM orders), p AS (SELECT scan_num, l_extendedprice AS mz, l_quantity AS i, row_number() OVER (PARTITION BY scan_num ORDER BY l_quantity DESC, l_extendedprice) AS r FROM w JOIN lineitem ON l_orderkey = scan_num AND l_extendedprice BETWEEN lo AND hi),
c AS (SELECT DISTINCT scan_num, mz, CAST(z AS INT) AS charge FROM p, range(1, 4) q(z) WHERE r <= 3 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = scan_num AND abs(mz + 1.00335483 / z - l.l_extendedprice) <= (mz + 1.00335483 / z) * 40000 / 1e6))"""


def _candidates(t):
    from spectroloom.operators import precursors

    s = t("orders").select(F.col("o_orderkey").alias("scan_num"), (F.col("o_totalprice") / 4 - 15000).alias("low_mz"), (F.col("o_totalprice") / 4 + 15000).alias("high_mz"), F.col("o_orderkey").alias("prev_at"), F.lit(None).cast("long").alias("next_at"))
    p = t("lineitem").select(F.col("l_orderkey").alias("ms1_scan"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))
    return precursors.precursor_candidates(s, p, (1, 3), 40000.0, 3)


@query("precursor_candidates", f"""WITH {PRECURSORS} SELECT * FROM c""")
def precursor_candidates(t):
    return _candidates(t).select("scan_num", "mz", "charge").distinct()


@query("candidates_at_several_charges", f"""WITH {PRECURSORS} SELECT scan_num, mz FROM c GROUP BY ALL HAVING count(*) = 3""")
def candidates_at_several_charges(t):
    # of one peak: the charges at which it has a neighbour
    return _candidates(t).groupBy("scan_num", "mz").agg(F.count_distinct("charge").alias("n")).where("n = 3").select("scan_num", "mz")


@query("correlated_candidates", """SELECT n_nationkey, CAST(s AS INT) AS scan_num, CAST(z AS INT) AS charge FROM nation, range(1, 4) a(s), range(5, 8) b(z)""")
def correlated_candidates(t):
    from spectroloom.operators import precursors

    s = _envelope_spectra(t, 3)
    peaks = spectra.exploded_peaks(s, "n_nationkey", "scan_num").withColumn("ms1_scan", F.col("n_nationkey") * 10 + F.col("scan_num"))
    scans = s.select((F.col("n_nationkey") * 10 + F.col("scan_num")).alias("scan_num"), F.lit(0.0).alias("low_mz"), F.lit(9000.0).alias("high_mz"), (F.col("n_nationkey") * 10 + F.col("scan_num")).alias("prev_at"), F.lit(None).cast("long").alias("next_at"))
    ms1 = peaks.select("ms1_scan", "mz", "intensity")
    good = precursors.correlated_candidates(precursors.precursor_candidates(scans, ms1, (3, 9), 5.0), ms1, 5.0, 0.98)
    at = F.floor(F.col("scan_num") / 10)
    near = good.withColumn("n_nationkey", at).where(F.abs(F.col("mass") - 5000.0 - F.col("n_nationkey") * 137.0) < 0.05)
    return precursors.several_charges(near, 3).select("n_nationkey", (F.col("scan_num") % 10).cast("int").alias("scan_num"), "charge").distinct()


@query("scans_of_candidates", """SELECT n_nationkey AS mass_id, n_nationkey * 10 + s AS scan_num FROM nation, range(1, 4) a(s)""")
def scans_of_candidates(t):
    from spectroloom.operators import precursors

    s = _envelope_spectra(t, 3)
    number = F.col("n_nationkey") * 10 + F.col("scan_num")
    ms1 = spectra.exploded_peaks(s, "n_nationkey", "scan_num").select(number.alias("ms1_scan"), "mz", "intensity")
    scans = s.select(number.alias("scan_num"), F.lit(0.0).alias("low_mz"), F.lit(9000.0).alias("high_mz"), number.alias("prev_at"), F.lit(None).cast("long").alias("next_at"))
    good = precursors.without_repeats(precursors.precursor_candidates(scans, ms1, (5, 7), 5.0))
    masses = t("nation").select(F.col("n_nationkey").alias("mass_id"), (F.lit(5000.0) + F.col("n_nationkey") * 137.0).alias("mass"))
    return precursors.candidate_scans(masses, "mass", good, 5.0, ["mass_id"]).where(F.floor(F.col("scan_num") / 10) == F.col("mass_id"))


@query("feature_extents", """SELECT n_nationkey AS mass_id, 5 AS apex, 3 AS min_scan, 7 AS max_scan, 5 AS min_charge, 7 AS max_charge FROM nation""")
def feature_extents(t):
    from spectroloom.operators import precursors

    _, m = _matrix(t)
    done = precursors.feature_extent(m.where(F.col("run") == F.concat(F.lit("run"), "mass_id")), 0.5)
    return done.select("mass_id", *[F.col(c).cast("int").alias(c) for c in ("apex", "min_scan", "max_scan", "min_charge", "max_charge")])


@query("suffix_order", f"""WITH p AS (SELECT n_nationkey AS k, {_sequence_sql("n_name || r_name")} AS s FROM nation JOIN region ON n_regionkey = r_regionkey), x AS (SELECT k, i AS start, substr(s, i, 12) AS suffix FROM p, range(1, 60) q(i) WHERE i <= length(s)),
l AS (SELECT *, coalesce(lag(suffix) OVER (ORDER BY suffix, k, start), '') AS b FROM x) SELECT k, CAST(start AS INT) AS start, suffix, CAST(len(list_filter(range(1, 13), lambda i: i <= length(suffix) AND i <= length(b) AND substr(suffix, 1, CAST(i AS INT)) = substr(b, 1, CAST(i AS INT)))) AS INT) AS common FROM l""")
def suffix_order(t):
    return sequences.suffix_order(_proteins(t), "n_nationkey", "sequence", 12).withColumnRenamed("n_nationkey", "k")


@query("shuffled_decoys", """SELECT p_partkey, length(p_name) AS n, array_to_string(list_sort(string_split(p_name, '')), '') AS letters FROM part""")
def shuffled_decoys(t):
    shuffled = t("part").select("p_partkey", text.decoy_shuffle(F.col("p_name"), F.lit(7)).alias("s"))
    return shuffled.select("p_partkey", F.length("s").cast("long").alias("n"), F.array_join(F.array_sort(F.filter(F.split("s", ""), lambda r: r != "")), "").alias("letters"))


@query("reachable_mass_bins", "WITH RECURSIVE s(d) AS (VALUES " + ", ".join(f"({d})" for d in sorted({round(m * 0.9995) for m in RESIDUE_MASS.values()})) + "), m AS (SELECT 0 AS bin UNION SELECT bin + d FROM m JOIN s ON bin + d <= 700) SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice % 700) AS BIGINT) IN (SELECT bin FROM m) AS reachable FROM lineitem")
def reachable_mass_bins(t):
    # which rows have a nominal mass (their price within 700) that some sequence of residues has
    bins = [int(b) for b in evidence.reachable_bins(700)]
    return t("lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") % 700).isin(bins).alias("reachable"))


@query("spline_slopes", """SELECT l_orderkey, l_linenumber AS x, CAST(l_orderkey % 7 AS DOUBLE) AS slope FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1) GROUP BY ALL""")
def spline_slopes(t):
    # a spline through points of a line has the line's slope at each of them
    points = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("x")).distinct().groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x")).where(F.size("x") > 1)
    rows = points.withColumn("y", F.transform("x", lambda x: x * (F.col("l_orderkey") % 7) + 3.0))
    each = rows.select("l_orderkey", F.explode(F.arrays_zip("x", numeric.slope_filter_udf(F.col("x"), F.col("y")).alias("s"))).alias("p"))
    return each.select("l_orderkey", F.col("p.x").cast("int").alias("x"), F.round("p.s", 6).alias("slope"))


@query("best_modified_paths", f"""WITH p AS (SELECT n_nationkey, {_sequence_sql("n_name || r_name")} AS s FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, CAST(length(s) AS DOUBLE) AS path_score, CASE WHEN regexp_matches(s, '[MW]') THEN length(s) - strpos(reverse(translate(s, 'W', 'M')), 'M') + 1 ELSE 0 END AS placed FROM p""")
def best_modified_paths(t):
    p = _proteins(t).withColumn("at", F.when(F.col("sequence").rlike("[MW]"), F.length("sequence") - F.locate("M", F.reverse(F.translate("sequence", "W", "M"))) + 1).otherwise(0))
    up = numeric.prefix_masses(F.col("sequence"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("sequence")), lambda i: F.get(F.col("up"), i) + F.when((F.col("at") > 0) & (i >= F.col("at")), F.lit(15.994915)).otherwise(F.lit(0.0)))
    rows = p.withColumn("up", up).withColumn("prefixes", prefixes).select("n_nationkey", "sequence", "prefixes")
    done = scoring.score_proteoforms(rows, ["n_nationkey"], "sequence", "prefixes", {"Ox": 15.994915}, {"Ox": "MW"}, 0.001)
    return done.select("n_nationkey", "path_score", F.array_position("placement", "Ox").alias("placed"))


@query("sql_functions", """SELECT p_partkey, (p_retailprice + 2 * 1.00335483) / 3 + 1.00727649 AS mz, CAST(round_even(p_retailprice * 0.9995, 0) AS BIGINT) AS bin, abs(p_retailprice - 1000) < p_retailprice * 50000 / 1e6 AS near FROM part""")
def sql_functions(t):
    from spectroloom.functions import registry

    p = t("part")
    registry.register(p.sparkSession)
    return p.sparkSession.sql("SELECT p_partkey, isotope_mz(p_retailprice, 3, 2) AS mz, nominal_bin(p_retailprice) AS bin, within_ppm(p_retailprice, 1000, 50000) AS near FROM {part}", part=p)


@query("digest_table_function", f"""WITH p AS (SELECT n_nationkey, {_sequence_sql("n_name")} AS s FROM nation), x AS (SELECT *, list_sort(list_distinct(list_concat([0, length(s)], list_filter(range(1, length(s)), lambda i: substr(s, CAST(i AS INT), 1) IN ('K', 'E'))))) AS cuts FROM p),
c AS (SELECT n_nationkey, s, unnest(range(1, len(cuts))) AS i, cuts FROM x), d AS (SELECT *, i + k AS j FROM c, range(1, 3) q(k) WHERE i + k <= len(cuts)) SELECT n_nationkey, substr(s, CAST(cuts[i] + 1 AS INT), CAST(cuts[j] - cuts[i] AS INT)) AS peptide, CAST(cuts[i] AS INT) AS start, CAST(j - i - 1 AS INT) AS missed FROM d""")
def digest_table_function(t):
    from spectroloom.functions import registry

    p = t("nation").select("n_nationkey", _sequence("n_name").alias("s"))
    registry.register(p.sparkSession)
    return p.sparkSession.sql("SELECT n_nationkey, d.* FROM {p}, LATERAL digest(s, 'KE', 1) AS d", p=p)


@query("fragments_table_function", f"""WITH {MASS_SQL}, p AS (SELECT n_nationkey AS k, {_sequence_sql("n_name")} AS s FROM nation), l AS (SELECT k, i, length(s) AS n, m FROM (SELECT k, s, i, substr(s, i, 1) AS x FROM p, range(1, 60) q(i) WHERE i <= length(s)) JOIN r ON r = x),
b AS (SELECT k, i, n, sum(m) OVER (PARTITION BY k ORDER BY i) AS pre, sum(m) OVER (PARTITION BY k) AS total FROM l) SELECT k, 'b' AS series, CAST(i AS INT) AS length, round(pre, 5) AS mass FROM b WHERE i < n UNION ALL SELECT k, 'y', CAST(n - i AS INT), round(total - pre + {WATER!r}, 5) FROM b WHERE i < n""")
def fragments_table_function(t):
    from spectroloom.functions import registry

    p = t("nation").select(F.col("n_nationkey").alias("k"), _sequence("n_name").alias("s"))
    registry.register(p.sparkSession)
    return p.sparkSession.sql("SELECT k, f.series, f.length, round(f.mass, 5) AS mass FROM {p}, LATERAL fragments(s) AS f", p=p)
