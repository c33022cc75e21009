"""Queries of plain filters, look-ups, set columns and counts."""

from pyspark.sql import functions as F

from spectroloom.functions.numeric import binomial
from spectroloom.operators import aggregates, filters, joins
from spectroloom.plans.registry import query


@query("scans_of_level", """SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice BETWEEN 50000 AND 190000""")
def scans_of_level(t):
    return filters.in_range(filters.of_level(t("orders"), "2-HIGH", "o_orderpriority"), "o_totalprice", 50000, 190000).select("o_orderkey")


@query("mass_range_filter", """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_extendedprice >= 30000 AND l_extendedprice <= 30500""")
def mass_range_filter(t):
    return filters.in_range(t("lineitem"), "l_extendedprice", 30000, 30500).select("l_orderkey", "l_partkey", "l_linenumber")


@query("sequence_length_filter", """SELECT p_partkey FROM part WHERE length(p_name) BETWEEN 9 AND 10""")
def sequence_length_filter(t):
    return filters.of_length(t("part"), "p_name", 9, 10).select("p_partkey")


@query("decoy_exclusion", """SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0""")
def decoy_exclusion(t):
    named = t("part").withColumn("protein", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("XXX_"), "p_name")).otherwise(F.col("p_name")))
    return filters.without_decoys(named, "protein").select("p_partkey")


@query("peptides_within_q", """SELECT DISTINCT p_name FROM part WHERE p_partkey % 3 <> 0 AND p_size <= 2""")
def peptides_within_q(t):
    named = t("part").withColumn("protein", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("XXX_"), "p_name")).otherwise(F.col("p_name")))
    return filters.peptides_within(named, "p_name", "protein", "p_size", 2)


@query("likelihood_threshold", """SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 AND l_tax > 0.03 GROUP BY l_suppkey""")
def likelihood_threshold(t):
    return filters.above(filters.above(t("lineitem"), "l_discount", 0.05), "l_tax", 0.03, strict=True).groupBy("l_suppkey").agg(F.count("*").alias("n"))


MOD_SQL = ", ".join(f"('{n}', {sum(k * filters.ATOM_MASS[a] for a, k in atoms.items())!r}::DOUBLE)" for n, atoms in filters.MODIFICATIONS.items())


@query("named_mass_shifts", f"""WITH m(name, mass) AS (VALUES {MOD_SQL}) SELECT p_partkey, arg_min(name, (abs(mass - shift), name)) FILTER (abs(mass - shift) <= 0.3) AS modification FROM (SELECT p_partkey, p_size * 2 - 20 AS shift FROM part) JOIN m ON true GROUP BY p_partkey""")
def named_mass_shifts(t):
    return filters.named_shifts(t("part").select("p_partkey", (F.col("p_size") * 2 - 20).alias("shift")), "shift", 0.3).select("p_partkey", "modification")


@query("offset_lookup", """WITH o AS (SELECT p_name, p_partkey, sum(length(p_name) + 1) OVER (ORDER BY p_name, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM part),
q AS (SELECT c_custkey, c_custkey * 7 AS place FROM customer), z AS (SELECT p_partkey, coalesce(s, 0) AS place FROM o) SELECT c_custkey, p_partkey FROM q ASOF JOIN z ON q.place >= z.place""")
def offset_lookup(t):
    from spectroloom.sources.fasta import with_offsets

    proteins = t("part").select(F.concat("p_name", F.lit("\x00"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("name"), F.col("p_name").alias("sequence"), "p_partkey")
    starts = with_offsets(proteins).select(F.lit(0).alias("k"), F.col("start_offset").alias("at"), "p_partkey")
    asked = t("customer").select("c_custkey", F.lit(0).alias("k"), (F.col("c_custkey") * 7).alias("at"))
    return joins.asof_join(asked, starts, "at", ["k"], ["p_partkey"]).select("c_custkey", F.col("asof_p_partkey").alias("p_partkey"))


@query("name_lookup", """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def name_lookup(t):
    # 25 and 5 rows: Spark broadcasts them by their files' sizes
    c = t("customer")
    return c.join(t("nation"), c["c_nationkey"] == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("scan_set_union", """SELECT mass_bin, array_to_string(list_sort(list(DISTINCT scan)), ',') AS scans FROM (SELECT CAST(floor(l_extendedprice / 20) AS BIGINT) AS mass_bin, l_linenumber AS scan FROM lineitem) GROUP BY mass_bin""")
def scan_set_union(t):
    rows = t("lineitem").groupBy(F.floor(F.col("l_extendedprice") / 20).alias("mass_bin")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("s"))
    return rows.select("mass_bin", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("scans"))


@query("consumed_nodes", """SELECT c_nationkey, count(DISTINCT c_custkey) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)) AS n_left, count(DISTINCT c_custkey) AS n FROM customer GROUP BY c_nationkey""")
def consumed_nodes(t):
    used = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    left = t("customer").join(used, "c_custkey", "left_anti").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n_left"))
    every = t("customer").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n"))
    return every.join(left, "c_nationkey", "left").select("c_nationkey", F.coalesce("n_left", F.lit(0).cast("long")).alias("n_left"), "n")


@query("binomials", """SELECT DISTINCT p_size AS n, p_size % 6 AS k, CAST(round(exp(lgamma(p_size + 1) - lgamma(p_size % 6 + 1) - lgamma(p_size - p_size % 6 + 1))) AS BIGINT) AS ways FROM part""")
def binomials(t):
    rows = t("part").select(F.col("p_size").alias("n"), (F.col("p_size") % 6).alias("k")).distinct()
    return rows.withColumn("ways", binomial(F.col("n"), F.col("k")))


@query("longest_and_total", """SELECT max(length(p_name)) AS longest, sum(length(p_name))::BIGINT AS residues, count(DISTINCT p_name) AS sequences FROM part""")
def longest_and_total(t):
    return t("part").agg(F.max(F.length("p_name")).cast("long").alias("longest"), F.sum(F.length("p_name")).alias("residues"), F.count_distinct("p_name").alias("sequences"))


@query("touching_scan_ranges", """WITH s AS (SELECT l_suppkey, l_orderkey AS lo, l_orderkey + l_quantity::BIGINT AS hi FROM lineitem), g AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS c FROM s),
r AS (SELECT *, sum(c) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT l_suppkey, min(lo) AS low, max(hi) AS high, count(*) AS n FROM r GROUP BY l_suppkey, run""")
def touching_scan_ranges(t):
    s = t("lineitem").select("l_suppkey", F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("hi"))
    return aggregates.merged_ranges(s, ["l_suppkey"], "lo", "hi").select("l_suppkey", "low", "high", "n")


@query("result_rows", """SELECT o_orderkey, c_name, o_totalprice * (SELECT count(*) FROM supplier) AS e_value FROM orders JOIN customer ON c_custkey = o_custkey""")
def result_rows(t):
    # the number of proteins multiplies each match's value: one row is joined
    n = t("supplier").agg(F.count("*").alias("n"))
    o = t("orders").join(F.broadcast(n))
    return o.join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", (F.col("o_totalprice") * F.col("n")).alias("e_value"))
