"""Chromatogram, aggregation and crosstab queries."""

from pyspark.sql import functions as F

from spectroloom.operators import aggregates, chromatograms
from spectroloom.plans.registry import query


@query("xic_max_per_scan", """SELECT l_orderkey, arg_max(l_extendedprice, (l_quantity, l_extendedprice)) AS mz, max(l_quantity) AS intensity FROM lineitem WHERE l_extendedprice BETWEEN 30000 AND 45000 GROUP BY l_orderkey""")
def xic_max_per_scan(t):
    return chromatograms.xic(t("lineitem"), "l_extendedprice", 30000, 45000, ["l_orderkey"], "l_quantity")


@query("xic_all_points", """SELECT l_orderkey, l_extendedprice, l_quantity FROM lineitem WHERE l_extendedprice BETWEEN 30000 AND 31000""")
def xic_all_points(t):
    return chromatograms.xic_points(t("lineitem"), "l_extendedprice", 30000, 31000, ["l_orderkey", "l_extendedprice", "l_quantity"])


@query("xic_zero_filled", """SELECT o_orderkey, coalesce(i, 0.0) AS intensity FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS i FROM lineitem WHERE l_extendedprice BETWEEN 30000 AND 45000 GROUP BY 1) ON l_orderkey = o_orderkey""")
def xic_zero_filled(t):
    points = chromatograms.xic(t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "l_extendedprice", 30000, 45000, ["o_orderkey"], "l_quantity")
    return chromatograms.zero_filled(t("orders").select("o_orderkey"), points, ["o_orderkey"]).select("o_orderkey", "intensity")


@query("product_xic", """SELECT o_orderkey, coalesce(i, 0.0) AS intensity FROM (SELECT * FROM orders WHERE CAST(round_even(o_totalprice / 10000, 0) AS BIGINT) = 12) o
  LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS i FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 60000 GROUP BY 1) ON l_orderkey = o_orderkey""")
def product_xic(t):
    scans = t("orders").where(F.bround(F.col("o_totalprice") / 10000).cast("long") == 12).select("o_orderkey")
    peaks = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(scans, "o_orderkey", "left_semi")
    points = chromatograms.xic(peaks, "l_extendedprice", 20000, 60000, ["o_orderkey"], "l_quantity")
    return chromatograms.zero_filled(scans, points, ["o_orderkey"]).select("o_orderkey", "intensity")


@query("xic_sum_and_apex", """SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, arg_max(event_id, (value, -event_id)) AS apex FROM events GROUP BY user_id""")
def xic_sum_and_apex(t):
    return chromatograms.xic_summary(t("events"), ["user_id"], "event_id", "value").withColumn("total", F.round("total", 4))


PAIRED = """(SELECT user_id, CAST(epoch(ts) / 86400 AS BIGINT) AS day, event_type, sum(value) AS v FROM events GROUP BY ALL)"""


def _daily(t, kind):
    day = F.bround(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    return t("events").where(F.col("event_type") == kind).groupBy("user_id", day.alias("day")).agg(F.sum("value").alias("v"))


@query("xic_correlation", f"""SELECT a.user_id, count(*) AS n, round(greatest(0.0, coalesce(CASE WHEN isnan(corr(a.v, b.v)) THEN 0 ELSE corr(a.v, b.v) END, 0.0)), 6) AS correlation
  FROM {PAIRED} a JOIN {PAIRED} b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type = 'view' AND b.event_type = 'click' GROUP BY a.user_id""")
def xic_correlation(t):
    done = chromatograms.xic_correlation(_daily(t, "view"), _daily(t, "click"), ["user_id"], "day", "v")
    return done.withColumn("correlation", F.round("correlation", 6))


@query("xic_cosine", f"""SELECT a.user_id, round(CASE WHEN sum(a.v * a.v) * sum(coalesce(b.v, 0) * coalesce(b.v, 0)) > 0 THEN sum(a.v * coalesce(b.v, 0)) / sqrt(sum(a.v * a.v) * sum(coalesce(b.v, 0) * coalesce(b.v, 0))) ELSE 0.0 END, 6) AS cosine
  FROM (SELECT * FROM {PAIRED} WHERE event_type = 'view') a LEFT JOIN (SELECT * FROM {PAIRED} WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.day = b.day GROUP BY a.user_id""")
def xic_cosine(t):
    done = chromatograms.xic_cosine(_daily(t, "view"), _daily(t, "click"), ["user_id"], "day", "v")
    return done.withColumn("cosine", F.round("cosine", 6))


@query("summed_spectrum", """SELECT CAST(floor(l_extendedprice / 500) AS BIGINT) AS mz_bin, round(median(l_extendedprice), 4) AS mz, sum(l_quantity) AS intensity, count(*) AS n FROM lineitem GROUP BY 1""")
def summed_spectrum(t):
    done = chromatograms.summed_spectrum(t("lineitem"), [], F.floor(F.col("l_extendedprice") / 500), "l_extendedprice", "l_quantity")
    return done.withColumn("mz", F.round("mz", 4))


@query("peak_list_sum", """SELECT l_partkey, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1""")
def peak_list_sum(t):
    li = t("lineitem")
    return chromatograms.merged_peaks(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), "l_partkey", "l_quantity")


@query("charge_fold_histogram", """SELECT CAST(round_even((p_retailprice - 1.00727649) * z * 0.9995, 0) AS BIGINT) AS mass_bin, CAST(sum(p_size) AS BIGINT) AS intensity, count(*) AS n, count(DISTINCT z) AS charges FROM part, range(2, 7) r(z) GROUP BY 1""")
def charge_fold_histogram(t):
    from spectroloom.functions.mass import nominal_bin

    return chromatograms.charge_fold(t("part"), "p_retailprice", "p_size", 2, 6, nominal_bin)


@query("area_under_curve", """SELECT user_id, round(sum(coalesce((s - ps) * (value + pv) / 2, 0)), 1) AS area, max(value) AS apex_intensity FROM (
  SELECT *, lag(s) OVER w AS ps, lag(value) OVER w AS pv FROM (SELECT *, CAST(epoch(ts) AS DOUBLE) / 60 AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)) GROUP BY user_id""")
def area_under_curve(t):
    e = t("events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 60e6)
    done = chromatograms.area_under_curve(e, ["user_id"], "s", "value", ["event_id"])
    return done.select("user_id", F.round("area", 1).alias("area"), "apex_intensity")


@query("centroids", """SELECT user_id, CAST(peak_no AS BIGINT) AS peak_no, round(sum(event_id * value) / sum(value), 4) AS centroid, round(sum(value), 4) AS intensity, count(*) AS n FROM (
  SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS peak_no FROM (
    SELECT *, CASE WHEN lag(value) OVER w >= value AND lead(value) OVER w > value THEN 1 ELSE 0 END AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) GROUP BY ALL""")
def centroids(t):
    done = chromatograms.centroids(t("events"), ["user_id"], "event_id", "value")
    return done.select("user_id", F.col("peak_no").cast("long").alias("peak_no"), F.round("centroid", 4).alias("centroid"), F.round("intensity", 4).alias("intensity"), "n")


@query("distinct_isolation_windows", """SELECT count(DISTINCT p_retailprice) AS windows, min(p_size) AS narrowest, count(DISTINCT p_retailprice) < 1000 AS dia FROM part""")
def distinct_isolation_windows(t):
    n = F.count_distinct("p_retailprice")
    return t("part").agg(n.alias("windows"), F.min("p_size").alias("narrowest"), (n < 1000).alias("dia"))


@query("distinct_counts", """SELECT l_returnflag, count(DISTINCT l_partkey) AS proteoforms, count(DISTINCT l_suppkey) AS proteins, count(DISTINCT l_orderkey) AS scans FROM lineitem GROUP BY l_returnflag""")
def distinct_counts(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("proteoforms"), F.count_distinct("l_suppkey").alias("proteins"), F.count_distinct("l_orderkey").alias("scans"))


@query("cluster_summary", """SELECT l_suppkey, count(*) AS n, min(l_linenumber) AS min_charge, max(l_linenumber) AS max_charge, min(l_orderkey) AS min_scan, max(l_orderkey) AS max_scan,
  round(median(l_extendedprice), 4) AS mass, sum(l_quantity) AS abundance, arg_max(l_orderkey, (l_quantity, -l_orderkey)) AS rep_scan FROM lineitem GROUP BY l_suppkey""")
def cluster_summary(t):
    return aggregates.cluster_summary(t("lineitem"), ["l_suppkey"], "l_linenumber", "l_orderkey", "l_extendedprice", "l_quantity").withColumn("mass", F.round("mass", 4))


CROSS = ", ".join(f"round(sum(value) FILTER (event_type = '{k}'), 4) AS {k}_total, max(value) FILTER (event_type = '{k}') AS {k}_best, count(event_id) FILTER (event_type = '{k}') AS {k}_n" for k in ("click", "view", "error"))


@query("crosstab", f"""SELECT user_id, {CROSS} FROM events GROUP BY user_id HAVING count(*) FILTER (event_type IN ('click', 'view', 'error')) > 0""")
def crosstab(t):
    kinds = ["click", "view", "error"]
    e = t("events").where(F.col("event_type").isin(*kinds))
    done = aggregates.crosstab(e, ["user_id"], "event_type", kinds, {"total": F.round(F.sum("value"), 4), "best": F.max("value"), "n": F.count("event_id")})
    return done.fillna(0, [f"{k}_n" for k in kinds])


@query("fixed_histogram", """SELECT l_returnflag, CASE WHEN l_extendedprice < 10000 THEN 0 WHEN l_extendedprice >= 90000 THEN 41 ELSE CAST(floor((l_extendedprice - 10000) / 2000) AS BIGINT) + 1 END AS bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def fixed_histogram(t):
    return aggregates.fixed_histogram(t("lineitem"), ["l_returnflag"], "l_extendedprice", 10000.0, 90000.0, 40)


@query("equal_height_histogram", """SELECT bin, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM (SELECT *, ntile(20) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS bin FROM orders) GROUP BY bin""")
def equal_height_histogram(t):
    done = aggregates.equal_height(t("orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"], 20)
    return done.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("otsu_threshold", """WITH c AS (SELECT l_suppkey, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice < 110000 GROUP BY ALL),
s AS (SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS w, CAST(sum(n * bin) OVER u AS DOUBLE) AS m, CAST(sum(n) OVER e AS DOUBLE) AS ww, CAST(sum(n * bin) OVER e AS DOUBLE) AS mm FROM c
  WINDOW u AS (PARTITION BY l_suppkey ORDER BY bin ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY l_suppkey)),
b AS (SELECT *, CASE WHEN ww > w THEN w * (ww - w) * (m / w - (mm - m) / (ww - w)) * (m / w - (mm - m) / (ww - w)) ELSE 0 END AS between_ FROM s)
SELECT l_suppkey, CAST(arg_max(bin, (between_, -bin)) * 5000 + 5000 AS DOUBLE) AS threshold, round(max(between_), 2) AS between_ FROM b GROUP BY l_suppkey""")
def otsu_threshold(t):
    done = aggregates.otsu_threshold(t("lineitem"), ["l_suppkey"], "l_extendedprice", 0.0, 110000.0, 22)
    return done.select("l_suppkey", "threshold", F.round("between", 2).alias("between_"))


@query("regression", """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(stddev_pop(l_extendedprice), 4) AS sd,
  round(sqrt(avg((l_quantity - l_extendedprice) * (l_quantity - l_extendedprice))), 4) AS rmsd FROM lineitem GROUP BY l_returnflag""")
def regression(t):
    done = aggregates.regression(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return done.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("sd", 4).alias("sd"), F.round("rmsd", 4).alias("rmsd"))


@query("sample_statistics", """SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, round(greatest(0.0, least(1.0, corr(l_quantity, l_extendedprice))), 6) AS correlation FROM lineitem GROUP BY l_suppkey""")
def sample_statistics(t):
    done = aggregates.sample_statistics(t("lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return done.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "correlation")])


@query("ion_frequency", """SELECT l_linenumber, count(*) FILTER (l_discount > 0.05) AS found, count(*) AS total FROM lineitem GROUP BY l_linenumber""")
def ion_frequency(t):
    return aggregates.found_and_total(t("lineitem"), ["l_linenumber"], F.col("l_discount") > 0.05)


RANKED = """(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate) AS r FROM lineitem)"""


@query("rank_table", f"""SELECT l_linenumber, CASE WHEN r BETWEEN 1 AND 5 THEN r ELSE 6 END AS rank_place, count(*) AS n FROM {RANKED} GROUP BY ALL""")
def rank_table(t):
    from spectroloom.operators.windows import intensity_ranks

    ranked = intensity_ranks(t("lineitem"), ["l_orderkey"], "l_extendedprice", ["l_partkey", "l_suppkey", "l_shipdate"])
    return aggregates.rank_table(ranked, ["l_linenumber"], "rank", 5).withColumn("rank_place", F.col("rank_place").cast("long"))


@query("rank_smoothing", """SELECT p_size, n, round(avg(n) OVER (PARTITION BY CASE WHEN p_size <= 10 THEN 0 ELSE 1 END, CASE WHEN p_size <= 10 THEN (p_size - 1) // 2 ELSE (p_size - 1) // 10 END), 6) AS smoothed FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size)""")
def rank_smoothing(t):
    table = t("part").groupBy("p_size").agg(F.count("*").alias("n")).withColumn("k", F.lit(0))
    done = aggregates.smoothed_ranks(table, ["k"], "p_size", "n", [10, 50], [2, 10])
    return done.select("p_size", "n", F.round("smoothed", 6).alias("smoothed"))


@query("offset_frequency", """SELECT CAST(floor((l_extendedprice / l_quantity - 1500 + 400) * 20 / 800) AS BIGINT) AS bin, count(*) AS n, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 9) AS frequency
  FROM lineitem WHERE abs(l_extendedprice / l_quantity - 1500) < 400 GROUP BY 1""")
def offset_frequency(t):
    done = aggregates.offset_frequencies(t("lineitem"), F.col("l_extendedprice") / F.col("l_quantity") - 1500, 400.0, 20, "l_orderkey")
    return done.withColumn("frequency", F.round("frequency", 9))


@query("pair_presence", """SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'neither' END AS pair, count(*) AS n FROM (
  SELECT value > 30 AS a, lead(value > 30) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1""")
def pair_presence(t):
    return aggregates.pair_presence(t("events"), ["user_id"], "event_id", F.col("value") > 30)


@query("correlation_score_table", """SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS intensity_bin, CAST(floor(l_discount * 50) AS BIGINT) AS score_bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def correlation_score_table(t):
    return t("lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("intensity_bin"), F.floor(F.col("l_discount") * 50).alias("score_bin")).agg(F.count("*").alias("n"))


@query("training_partitions", """SELECT o_orderstatus, CAST(q AS BIGINT) AS quantile, count(*) AS n, round(avg(o_totalprice), 4) AS mean_mass FROM (SELECT *, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS q FROM orders) GROUP BY ALL""")
def training_partitions(t):
    done = aggregates.equal_height(t("orders"), ["o_orderstatus"], "o_totalprice", ["o_orderkey"], 4)
    return done.groupBy("o_orderstatus", F.col("bin").cast("long").alias("quantile")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_mass"))


@query("substring_row_estimate", """SELECT CAST(sum(CASE WHEN least(n, 8) >= 3 THEN (least(n, 8) - 3 + 1) * (n + 1) - (least(n, 8) * (least(n, 8) + 1) - 3 * 2) / 2 ELSE 0 END) AS BIGINT) AS n_substrings, max(n) AS longest FROM (SELECT length(p_name) AS n FROM part)""")
def substring_row_estimate(t):
    done = aggregates.substring_count(t("part"), F.length("p_name"), 3, 8)
    return done.withColumn("longest", F.col("longest").cast("long"))


@query("noise_feature_sum", """SELECT s_suppkey, round(sum(m), 4) AS noise, count(*) AS scans FROM supplier JOIN (SELECT l_suppkey, l_orderkey, median(l_extendedprice) AS m FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey
  WHERE l_orderkey BETWEEN s_suppkey * 10 AND s_suppkey * 10 + 5000 GROUP BY s_suppkey""")
def noise_feature_sum(t):
    from spectroloom.operators.joins import interval_join

    medians = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey").agg(F.median("l_extendedprice").alias("m"))
    spans = t("supplier").select("s_suppkey", F.col("s_suppkey").alias("feature"), (F.col("s_suppkey") * 10).alias("lo"), (F.col("s_suppkey") * 10 + 5000).alias("hi"))
    return interval_join(medians, spans, "l_orderkey", "lo", "hi", 5000.0, ["s_suppkey"]).groupBy("s_suppkey").agg(F.round(F.sum("m"), 4).alias("noise"), F.count("*").alias("scans"))


@query("observation_counter", """SELECT upper(sha1(p_name)) AS digest, count(*) AS n FROM part GROUP BY 1""")
def observation_counter(t):
    from spectroloom.functions.text import sha1_upper

    return t("part").groupBy(sha1_upper(F.col("p_name")).alias("digest")).agg(F.count("*").alias("n"))


@query("even_odd_charge_scores", """SELECT l_suppkey, l_linenumber % 2 AS parity, min(l_discount) AS best_distance, max(l_tax) AS best_correlation, sum(l_quantity) AS abundance FROM lineitem GROUP BY ALL""")
def even_odd_charge_scores(t):
    return t("lineitem").groupBy("l_suppkey", (F.col("l_linenumber") % 2).alias("parity")).agg(F.min("l_discount").alias("best_distance"), F.max("l_tax").alias("best_correlation"), F.sum("l_quantity").alias("abundance"))


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    rows = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("n"))
