"""Band, interval, as-of, bin, substring, semi and anti joins, set operations and components."""

from pyspark.sql import functions as F

from spectroloom.operators import aggregates, graph, joins
from spectroloom.plans.registry import query


@query("band_join_ppm", """SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a JOIN part b ON abs(a.p_retailprice - b.p_retailprice) <= a.p_retailprice * 200 / 1e6 AND a.p_brand = b.p_brand""")
def band_join_ppm(t):
    a = t("part").select("p_partkey", "p_retailprice", "p_brand")
    b = a.select(F.col("p_partkey").alias("right_key"), F.col("p_retailprice").alias("right_price"), "p_brand")
    return joins.band_join(a, b, "p_retailprice", "right_price", 200, "ppm", ["p_brand"]).select(F.col("p_partkey").alias("left_key"), "right_key")


@query("band_join_da_strict", """SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) < 1.5""")
def band_join_da_strict(t):
    s, c = t("supplier").select("s_suppkey", "s_acctbal"), t("customer").select("c_custkey", "c_acctbal")
    return joins.band_join(s, c, "s_acctbal", "c_acctbal", 1.5, "da", strict=True).select("s_suppkey", "c_custkey")


@query("band_semi_join", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE abs(c_acctbal - s_acctbal) <= 0.8)""")
def band_semi_join(t):
    return joins.band_join(t("customer"), t("supplier").select("s_acctbal"), "c_acctbal", "s_acctbal", 0.8, how="left_semi").select("c_custkey")


@query("band_anti_join", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE abs(c_acctbal - s_acctbal) <= 0.8)""")
def band_anti_join(t):
    return joins.band_join(t("customer"), t("supplier").select("s_acctbal"), "c_acctbal", "s_acctbal", 0.8, how="left_anti").select("c_custkey")


@query("strongest_in_band", """SELECT s_suppkey, arg_max(c_custkey, (c_custkey % 97, c_custkey)) AS c_custkey FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 20 GROUP BY s_suppkey""")
def strongest_in_band(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    return joins.best_in_band(t("supplier"), c, "s_acctbal", "c_acctbal", 20.0, F.col("c_custkey") % 97, ["c_custkey"], ["s_suppkey"])


@query("interval_join_orders_shipments", """SELECT o_orderkey, l_partkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY""")
def interval_join_orders_shipments(t):
    day = lambda c: (F.unix_timestamp(F.col(c).cast("timestamp")) / 86400).alias("d")
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", day("l_shipdate").alias("at"))
    o = t("orders").select(F.col("o_orderkey"), F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("lo"), (day("o_orderdate") + 60).alias("hi"))
    return joins.interval_join(li, o, "at", "lo", "hi", 60.0, ["l_orderkey"], closed="low").select("o_orderkey", "l_partkey", "l_linenumber")


@query("interval_join_features", """SELECT s_suppkey, c_custkey FROM customer JOIN supplier ON c_acctbal > s_acctbal - 5 AND c_acctbal < s_acctbal + 5""")
def interval_join_features(t):
    s = t("supplier").select("s_suppkey", (F.col("s_acctbal") - 5).alias("lo"), (F.col("s_acctbal") + 5).alias("hi"))
    return joins.interval_join(t("customer"), s, "c_acctbal", "lo", "hi", 10.0, closed="neither").select("s_suppkey", "c_custkey")


SPANS = "SELECT c_custkey AS id, c_nationkey AS k, c_acctbal AS lo, c_acctbal + c_custkey % 40 AS hi FROM customer"


@query("overlap_join", f"""WITH s AS ({SPANS}) SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.k = b.k AND a.id < b.id AND a.lo - 2 < b.hi AND b.lo < a.hi + 2""")
def overlap_join(t):
    s = t("customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + F.col("c_custkey") % 40).alias("hi"))
    r = s.select(F.col("a").alias("b"), "k", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return joins.overlap_join(s, r, ("lo", "hi"), ("lo2", "hi2"), 40.0, 2.0, ["k"]).where("a < b").select("a", "b")


@query("asof_backward", """SELECT a.event_id, b.event_id AS asof_error_id FROM (SELECT * FROM events WHERE event_type <> 'error') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_backward(t):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return joins.asof_join(e.where("event_type <> 'error'"), errors, "ts", ["user_id"], ["error_id"]).select("event_id", "asof_error_id")


@query("asof_forward", """SELECT a.event_id, b.event_id AS asof_error_id FROM (SELECT * FROM events WHERE event_type <> 'error') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.ts <= b.ts""")
def asof_forward(t):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return joins.asof_join(e.where("event_type <> 'error'"), errors, "ts", ["user_id"], ["error_id"], "forward").select("event_id", "asof_error_id")


@query("previous_next_scan", """SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_at,
  first_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_at FROM events""")
def previous_next_scan(t):
    return joins.previous_and_next(t("events"), "event_id", ["user_id"], F.col("event_type") == "view").select("event_id", "prev_at", "next_at")


@query("bin_equi_join", """SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON CAST(round_even(p_retailprice * 10, 0) AS BIGINT) = CAST(round_even(l_extendedprice, 0) AS BIGINT)""")
def bin_equi_join(t):
    p = t("part").select("p_partkey", F.bround(F.col("p_retailprice") * 10).cast("long").alias("bin"))
    li = t("lineitem").select("l_orderkey", "l_linenumber", F.bround("l_extendedprice").cast("long").alias("bin"))
    return p.join(li, "bin").select("p_partkey", "l_orderkey", "l_linenumber")


@query("sorted_merge_intersection", """SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45""")
def sorted_merge_intersection(t):
    li = t("lineitem")
    return li.where("l_returnflag = 'A'").select("l_partkey").intersect(li.where("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey"))


@query("venn_sets", """SELECT CASE WHEN o_custkey IS NULL THEN 'only_left' WHEN c_custkey IS NULL THEN 'only_right' ELSE 'both' END AS part, count(*) AS n
  FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey GROUP BY 1""")
def venn_sets(t):
    c = t("customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("c_custkey").distinct()
    o = t("orders").where("o_totalprice > 200000").select("o_custkey").distinct()
    part = F.when(F.col("o_custkey").isNull(), "only_left").when(F.col("c_custkey").isNull(), "only_right").otherwise("both")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("set_difference", """SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def set_difference(t):
    return t("customer").select("c_custkey").subtract(t("orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("union_target_decoy", """SELECT c_custkey AS id, false AS decoy FROM customer UNION ALL SELECT s_suppkey AS id, true AS decoy FROM supplier""")
def union_target_decoy(t):
    return t("supplier").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("decoy")).unionByName(t("customer").select(F.col("c_custkey").alias("id"), F.lit(False).alias("decoy")))


@query("scan_list_semi_join", """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def scan_list_semi_join(t):
    scans = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").join(scans, "l_orderkey", "left_semi").select("l_orderkey", "l_partkey", "l_linenumber")


@query("range_union", """WITH r AS (SELECT c_nationkey AS k, CAST(c_acctbal AS BIGINT) AS lo, CAST(c_acctbal AS BIGINT) + c_custkey % 50 AS hi, c_custkey FROM customer),
g AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS s FROM r),
u AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT k, min(lo) AS low, max(hi) AS high, count(*) AS n FROM u GROUP BY k, run""")
def range_union(t):
    lo = F.bround("c_acctbal").cast("long")
    r = t("customer").select(F.col("c_nationkey").alias("k"), lo.alias("lo"), (lo + F.col("c_custkey") % 50).alias("hi"))
    return aggregates.merged_ranges(r, ["k"], "lo", "hi").select("k", "low", "high", "n")


@query("substring_join", """SELECT p.p_partkey, w.word, strpos(p.p_name, w.word) - 1 AS position FROM part p JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part) w ON contains(p.p_name, w.word)""")
def substring_join(t):
    parts = t("part").select("p_partkey", "p_name")
    words = parts.select(F.element_at(F.split("p_name", " "), 2).alias("word")).distinct()
    return joins.substring_join(parts, words, "p_name", "word", 3, ["p_partkey"]).select("p_partkey", "word", F.col("position").cast("long").alias("position"))


@query("substring_join_rare", """WITH h AS (SELECT p.p_partkey, w.word FROM part p JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part) w ON contains(p.p_name, w.word))
SELECT p_partkey, word FROM h WHERE word IN (SELECT word FROM h GROUP BY word HAVING count(*) <= 200)""")
def substring_join_rare(t):
    parts = t("part").select("p_partkey", "p_name")
    words = parts.select(F.element_at(F.split("p_name", " "), 2).alias("word")).distinct()
    return joins.substring_join(parts, words, "p_name", "word", 3, ["p_partkey"], 200).select("p_partkey", "word")


@query("connected_components", """WITH RECURSIVE e AS (SELECT a.s_suppkey AS u, b.s_suppkey AS v FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 60),
r AS (SELECT s_suppkey AS id, s_suppkey AS c FROM supplier UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id) SELECT id, min(c) AS component FROM r GROUP BY id""")
def connected_components(t):
    n = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return graph.connected_components(n.select("id"), joins.band_links(n, "id", "x", 60.0))


@query("component_clusters", """WITH s AS (SELECT *, CASE WHEN c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) > 30 THEN 1 ELSE 0 END AS g FROM customer),
r AS (SELECT *, sum(g) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT min(c_custkey) AS component, count(*) AS n, round(median(c_acctbal), 4) AS mass, min(c_acctbal) AS low, max(c_acctbal) AS high FROM r GROUP BY c_nationkey, run""")
def component_clusters(t):
    n = t("customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_acctbal").alias("x"))
    found = graph.connected_components(n, joins.band_links(n, "id", "x", 30.0, ["c_nationkey"]))
    return found.groupBy("component").agg(F.count("*").alias("n"), F.round(F.median("x"), 4).alias("mass"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("shared_members", """SELECT a.c_nationkey AS a, b.c_nationkey AS b FROM (SELECT c_nationkey, list(DISTINCT c_mktsegment) AS s FROM customer GROUP BY 1) a
  JOIN (SELECT c_nationkey, list(DISTINCT c_mktsegment) AS s FROM customer GROUP BY 1) b ON a.c_nationkey < b.c_nationkey AND list_has_any(a.s, b.s)""")
def shared_members(t):
    s = t("customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("s"))
    a = s.select(F.col("c_nationkey").alias("a"), F.explode("s").alias("m"))
    # pairs are made through a member that they share
    return a.join(a.withColumnRenamed("a", "b"), "m").where("a < b").select("a", "b").distinct()
