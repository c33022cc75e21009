"""Window, ranking and noise queries."""

from pyspark.sql import functions as F

from spectroloom.operators import ranking, windows
from spectroloom.plans.registry import query


def _matches(t):
    """Orders as matches: clerk-like scan groups, a score, a probability and a decoy flag."""
    o = t("orders")
    return o.select(
        "o_orderkey", (F.col("o_orderkey") % 4000).alias("scan"), F.concat(F.lit("P"), (F.col("o_custkey") % 700).cast("string")).alias("peptide"),
        F.round(F.col("o_totalprice") / 1000, 0).alias("e_value"), (F.col("o_custkey") % 10 / 10.0).alias("probability"), (F.col("o_orderstatus") == "P").alias("decoy"),
    )


MATCHES = """m AS (SELECT o_orderkey, o_orderkey % 4000 AS scan, 'P' || CAST(o_custkey % 700 AS VARCHAR) AS peptide, round(o_totalprice / 1000, 0) AS e_value,
  (o_custkey % 10) / 10.0 AS probability, o_orderstatus = 'P' AS decoy FROM orders)"""
QVALUES = """
{prefix} AS (SELECT *, CASE WHEN t = 0 THEN 1.0 ELSE least(1.0, d / CAST(t AS DOUBLE)) END AS fdr FROM (SELECT *, sum(CAST(decoy AS INT)) OVER w AS d, sum(1 - CAST(decoy AS INT)) OVER w AS t
  FROM {source} WINDOW w AS (ORDER BY e_value, probability DESC, decoy DESC, o_orderkey ROWS UNBOUNDED PRECEDING))),
{prefix}q AS (SELECT *, min(fdr) OVER (ORDER BY e_value, probability DESC, decoy DESC, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM {prefix})"""


@query("fdr_q_values", f"""WITH {MATCHES},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY e_value, probability DESC, decoy DESC, o_orderkey) AS n FROM m) WHERE n = 1),
{QVALUES.format(prefix="s", source="b")},
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY e_value, probability DESC, decoy DESC, o_orderkey) AS k FROM b) WHERE k = 1),
{QVALUES.format(prefix="r", source="p")}
SELECT sq.o_orderkey, sq.scan, sq.peptide, round(sq.q, 9) AS q_value, round(rq.q, 9) AS pep_q_value FROM sq JOIN rq ON sq.peptide = rq.peptide""")
def fdr_q_values(t):
    done = windows.target_decoy_fdr(_matches(t), "scan", "peptide", "e_value", "probability", "decoy", [F.col("o_orderkey")])
    return done.select("o_orderkey", "scan", "peptide", F.round("q_value", 9).alias("q_value"), F.round("pep_q_value", 9).alias("pep_q_value"))


@query("fdr_filtered_peptides", f"""WITH {MATCHES},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY e_value, probability DESC, decoy DESC, o_orderkey) AS n FROM m) WHERE n = 1),
{QVALUES.format(prefix="s", source="b")}
SELECT peptide, count(*) AS n FROM sq WHERE q <= 0.3 AND NOT decoy GROUP BY peptide""")
def fdr_filtered_peptides(t):
    m = _matches(t)
    best = windows.best_per(m, ["scan"], [F.col("e_value"), F.col("probability").desc(), F.col("decoy").desc(), F.col("o_orderkey")])
    q = windows.running_fdr(best, "e_value", "decoy", [F.col("probability").desc(), F.col("decoy").desc(), F.col("o_orderkey")])
    return q.where((F.col("q_value") <= 0.3) & ~F.col("decoy")).groupBy("peptide").agg(F.count("*").alias("n"))


@query("result_ids", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_totalprice, o_orderkey) AS result_id FROM orders""")
def result_ids(t):
    order = [F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderkey")]
    return ranking.top_k(t("orders"), ["o_orderpriority"], order, 2**31 - 1).select("o_orderkey", F.col("place").cast("long").alias("result_id"))


@query("scan_grouped_order", """SELECT l_orderkey, l_partkey, l_linenumber, min(l_extendedprice) OVER (PARTITION BY l_orderkey) AS scan_best FROM lineitem""")
def scan_grouped_order(t):
    from pyspark.sql import Window

    return t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.min("l_extendedprice").over(Window.partitionBy("l_orderkey")).alias("scan_best"))


@query("peak_rankings", """SELECT l_orderkey, l_partkey, l_extendedprice, CASE WHEN l_extendedprice > 20000 THEN
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_shipdate, l_suppkey) ELSE 0 END AS rank FROM lineitem""")
def peak_rankings(t):
    done = windows.intensity_ranks(t("lineitem"), ["l_orderkey"], "l_extendedprice", ["l_partkey", "l_linenumber", "l_shipdate", "l_suppkey"], 20000)
    return done.select("l_orderkey", "l_partkey", "l_extendedprice", F.col("rank").cast("long").alias("rank"))


@query("xic_gap_sessions", """SELECT event_id, user_id, CAST(sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000000 THEN 1 ELSE 0 END AS g FROM events)""")
def xic_gap_sessions(t):
    e = t("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return windows.gap_sessions(e, ["user_id"], "us", 3_600_000_000).select("event_id", "user_id", F.col("session").cast("long").alias("session"))


@query("xic_trimmed", """WITH s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 14400000000 THEN 1 ELSE 0 END AS g,
    first_value(us) OVER (PARTITION BY user_id ORDER BY value DESC, us) AS target FROM (SELECT event_id, user_id, value, epoch_us(ts) AS us FROM events)))
SELECT event_id, s.user_id, value FROM s JOIN (SELECT user_id, session FROM s WHERE us = target) o ON s.user_id = o.user_id AND s.session = o.session""")
def xic_trimmed(t):
    from pyspark.sql import Window

    e = t("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("target", F.first("us").over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "us")))
    return windows.trimmed_around(e, ["user_id"], "us", "target", 14_400_000_000).select("event_id", "user_id", "value")


@query("local_maxima", """SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY d RANGE BETWEEN 90 PRECEDING AND 90 FOLLOWING) AS m
  FROM (SELECT *, CAST(epoch(o_orderdate) / 86400 AS DOUBLE) AS d FROM orders)) WHERE m = o_totalprice""")
def local_maxima(t):
    o = t("orders").withColumn("d", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400.0)
    return windows.local_maxima(o, ["o_custkey"], "d", "o_totalprice", 90.0).select("o_orderkey", "o_custkey", "o_totalprice")


@query("window_rank_filter", """SELECT o_orderkey FROM orders a WHERE (SELECT count(*) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_totalprice > a.o_totalprice
  AND abs(epoch(b.o_orderdate) - epoch(a.o_orderdate)) <= 200 * 86400) < 2""")
def window_rank_filter(t):
    o = t("orders").withColumn("d", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400.0)
    return windows.window_rank_filter(o, ["o_custkey"], "d", "o_totalprice", 400.0, 2).select("o_orderkey")


@query("noise_global_median", """SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, list_sort(list(l_extendedprice) OVER (PARTITION BY l_orderkey), 'DESC') AS s FROM lineitem)
  WHERE l_extendedprice >= s[CAST(floor(len(s) / 2.0) AS INT) + 1] * 1.4826""")
def noise_global_median(t):
    return windows.global_noise(t("lineitem"), ["l_orderkey"], "l_extendedprice").select("l_orderkey", "l_partkey", "l_extendedprice")


@query("noise_local_window", """SELECT o_orderkey FROM (SELECT *, list_sort(list_distinct(list(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY d RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING))) AS s
  FROM (SELECT *, CAST(epoch(o_orderdate) / 86400 AS DOUBLE) AS d FROM orders)) WHERE o_totalprice >= s[CAST(floor(len(s) / 2.0) AS INT) + 1] * 1.1""")
def noise_local_window(t):
    o = t("orders").withColumn("d", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400.0)
    return windows.local_window_noise(o, ["o_custkey"], "d", "o_totalprice", 300.0, 1.1).select("o_orderkey")


@query("moving_sum_3", """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smoothed FROM events""")
def moving_sum_3(t):
    return windows.moving_sum(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query("savitzky_golay_9", """SELECT event_id, round((-21 * coalesce(lag(value, 4) OVER w, 0) + 14 * coalesce(lag(value, 3) OVER w, 0) + 39 * coalesce(lag(value, 2) OVER w, 0) + 54 * coalesce(lag(value, 1) OVER w, 0)
  + 59 * value + 54 * coalesce(lead(value, 1) OVER w, 0) + 39 * coalesce(lead(value, 2) OVER w, 0) + 14 * coalesce(lead(value, 3) OVER w, 0) - 21 * coalesce(lead(value, 4) OVER w, 0)) / 231, 5) AS smoothed
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def savitzky_golay_9(t):
    return windows.savitzky_golay(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("smoothed", 5).alias("smoothed"))


@query("half_shifted_grids", """WITH r AS (SELECT o_custkey, o_totalprice AS p, grid, CAST(floor((o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey)) / 50000 + grid * 0.5) AS BIGINT) AS mz_bin
  FROM orders, (VALUES (0), (1)) AS g(grid)), h AS (SELECT *, max(p) OVER (PARTITION BY o_custkey, grid, mz_bin) AS top FROM r)
SELECT o_custkey, grid, mz_bin, count(*) AS n, round(median(p), 4) AS median, max(top) AS highest, count(*) FILTER (p > top * 0.1) AS n_high FROM h GROUP BY o_custkey, grid, mz_bin""")
def half_shifted_grids(t):
    done = windows.half_shifted_grids(t("orders"), ["o_custkey"], "o_totalprice", "o_totalprice", 50000.0)
    return done.withColumn("median", F.round("median", 4))


@query("prefix_suffix_sums", """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS prefix,
  round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 4) AS suffix FROM events""")
def prefix_suffix_sums(t):
    done = windows.prefix_sums(t("events"), ["user_id"], ["ts", "event_id"], "value")
    return done.select("event_id", F.round("prefix", 4).alias("prefix"), F.round("suffix", 4).alias("suffix"))


@query("summed_by_time", """SELECT event_id, round(sum(value) OVER w, 4) AS window_sum, count(*) OVER w AS window_n FROM (SELECT *, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS s FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 7200 PRECEDING AND 7200 FOLLOWING)""")
def summed_by_time(t):
    e = t("events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    done = windows.summed_by_time(e, ["user_id"], "s", "value", 7200.0)
    return done.select("event_id", F.round("window_sum", 4).alias("window_sum"), "window_n")


@query("top_k_distinct_scores", """SELECT l_suppkey, l_quantity, l_extendedprice, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_extendedprice DESC) AS one FROM lineitem) WHERE one = 1) WHERE place <= 3""")
def top_k_distinct_scores(t):
    done = ranking.top_k_distinct_scores(t("lineitem"), ["l_suppkey"], "l_quantity", [F.col("l_extendedprice").desc()], 3)
    return done.select("l_suppkey", "l_quantity", "l_extendedprice", F.col("place").cast("long").alias("place"))


@query("top_k_ratio_cutoff", """SELECT l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS place, max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS m FROM lineitem)
  WHERE l_extendedprice >= m * 0.97 AND place <= 5""")
def top_k_ratio_cutoff(t):
    return ranking.top_k_with_ratio(t("lineitem"), ["l_suppkey"], "l_extendedprice", [], 5, 0.97).select("l_suppkey", "l_extendedprice")


@query("top_n_with_ties", """SELECT l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_extendedprice, l_orderkey, l_linenumber) AS place,
  min(l_quantity) OVER (PARTITION BY l_suppkey) AS f FROM lineitem) WHERE place <= 2 OR l_quantity = f""")
def top_n_with_ties(t):
    done = ranking.top_n_with_ties(t("lineitem"), ["l_suppkey"], "l_quantity", [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 2)
    return done.select("l_suppkey", "l_quantity", "l_extendedprice")


@query("nearest_n_by_time", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 25), event_id) AS n FROM events) WHERE n <= 4""")
def nearest_n_by_time(t):
    done = ranking.nearest_n(t("events").withColumn("target", F.lit(25.0)), ["user_id"], "value", "target", [F.col("event_id")], 4)
    return done.select("user_id", "event_id")


@query("best_peak_per_index", """SELECT l_suppkey, mass_index, arg_max(l_partkey, (l_quantity, l_extendedprice)) AS l_partkey FROM (SELECT *, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS mass_index FROM lineitem) GROUP BY ALL""")
def best_peak_per_index(t):
    rows = t("lineitem").withColumn("mass_index", F.floor(F.col("l_extendedprice") / 5000))
    return windows.best_per(rows, ["l_suppkey", "mass_index"], [F.col("l_quantity").desc(), F.col("l_extendedprice").desc()]).select("l_suppkey", "mass_index", "l_partkey")


@query("net_elution_time", """SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / CAST(max(epoch_us(ts)) OVER (PARTITION BY user_id) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE), 9) AS net FROM events""")
def net_elution_time(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", F.round((us - F.min(us).over(w)) / (F.max(us).over(w) - F.min(us).over(w)), 9).alias("net"))


@query("sorted_peaks", """SELECT l_extendedprice, l_orderkey FROM lineitem""")
def sorted_peaks(t):
    return ranking.sorted_by(t("lineitem").select("l_extendedprice", "l_orderkey"), "l_extendedprice", "l_orderkey")
