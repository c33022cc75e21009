"""Queries of scalar and array functions."""

from pyspark.sql import functions as F

from spectroloom.functions import arrays, mass, text
from spectroloom.plans.registry import query


@query("tolerance_predicates", """SELECT l_orderkey, l_partkey, l_linenumber, abs(l_extendedprice - l_quantity * 2000) < l_extendedprice * 50000 / 1e6 AS by_ppm, abs(l_extendedprice - l_quantity * 2000) < 1000 AS by_da,
  l_extendedprice >= l_quantity * 2000 - 500 AND l_extendedprice < l_quantity * 2000 + 250 AS in_window FROM lineitem""")
def tolerance_predicates(t):
    a, b = F.col("l_extendedprice"), F.col("l_quantity") * 2000
    return t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", mass.within_ppm(a, b, 50000).alias("by_ppm"), mass.within_da(a, b, 1000).alias("by_da"), mass.in_isolation_window(a, b, F.lit(500), F.lit(250)).alias("in_window"))


@query("isotope_mz", """SELECT p_partkey, round((p_retailprice + p_size % 5 * 1.00335483) / (p_size % 7 + 1) + 1.00727649, 6) AS mz, round((p_retailprice - 1.00727649) * (p_size % 7 + 1) - 1.00335483, 6) AS mono FROM part""")
def isotope_mz(t):
    z, m = F.col("p_size") % 7 + 1, F.col("p_retailprice")
    return t("part").select("p_partkey", F.round(mass.isotope_mz(m, z, F.col("p_size") % 5), 6).alias("mz"), F.round(mass.mono_mass(m, z, F.lit(1)), 6).alias("mono"))


@query("mass_bins", """SELECT l_orderkey, l_partkey, l_linenumber, CAST(round_even(l_extendedprice * 0.9995, 0) AS BIGINT) AS nominal, CAST(round_even(l_extendedprice * 274.335215, 0) AS BIGINT) AS fine FROM lineitem""")
def mass_bins(t):
    m = F.col("l_extendedprice")
    return t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", mass.nominal_bin(m).alias("nominal"), mass.fine_bin(m).alias("fine"))


@query("float_bits_bin", """SELECT l_orderkey, l_partkey, l_linenumber, CAST((1023 + e) * 32768 + floor((m / pow(2.0, e) - 1) * 32768) AS BIGINT) AS mz_bin FROM (
  SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS m, CASE WHEN l_extendedprice < 1024 THEN 9 WHEN l_extendedprice < 2048 THEN 10 WHEN l_extendedprice < 4096 THEN 11 WHEN l_extendedprice < 8192 THEN 12
   WHEN l_extendedprice < 16384 THEN 13 WHEN l_extendedprice < 32768 THEN 14 WHEN l_extendedprice < 65536 THEN 15 ELSE 16 END AS e FROM lineitem)""")
def float_bits_bin(t):
    return t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", mass.float_bits_bin(F.col("l_extendedprice")).alias("mz_bin"))


@query("charge_span", """SELECT p_partkey, z FROM (SELECT p_partkey, greatest(1, CAST(ceil(p_retailprice * 10 / (2000 - 1.00727649)) AS BIGINT)) AS a, CAST(floor(p_retailprice * 10 / (600 - 1.00727649)) AS BIGINT) AS b FROM part), range(1, 60) r(z) WHERE z BETWEEN a AND b""")
def charge_span(t):
    return t("part").select("p_partkey", F.explode(mass.charge_span(F.col("p_retailprice") * 10, 600.0, 2000.0)).alias("z"))


@query("logistic_probability", """SELECT event_id, round(1.0 / (1.0 + exp(-(value / 50 - 2.0))), 9) AS probability FROM events""")
def logistic_probability(t):
    return t("events").select("event_id", F.round(mass.logistic(F.col("value") / 50, -2.0), 9).alias("probability"))


@query("string_between_dots", """SELECT p_partkey, p_type AS middle, 'A.' || p_type || '.' || p_brand AS annotation FROM part""")
def string_between_dots(t):
    a = text.annotation(F.lit("A"), F.col("p_type"), F.col("p_brand"))
    return t("part").select("p_partkey", text.between_dots(a).alias("middle"), a.alias("annotation"))


@query("modification_strings", """SELECT p_partkey, p_brand || ' ' || p_size || ',' || p_type || ' ' || (p_size + 1) AS formatted, 2 AS n, p_size + p_size + 1 AS position_sum FROM part""")
def modification_strings(t):
    s = F.concat("p_brand", F.lit(" "), "p_size", F.lit(","), "p_type", F.lit(" "), F.col("p_size") + 1)
    parsed = t("part").select("p_partkey", text.parse_modifications(s).alias("mods"))
    return parsed.select("p_partkey", text.format_modifications(F.col("mods")).alias("formatted"), F.size("mods").alias("n"), F.aggregate("mods", F.lit(0), lambda a, m: a + m["position"]).alias("position_sum"))


@query("composition_strings", """SELECT p_partkey, 'C(' || (p_size + 3) || ') H(' || p_size * 2 || ') O(1)' AS total FROM part""")
def composition_strings(t):
    parsed = t("part").select("p_partkey", text.parse_composition(F.concat(F.lit("C("), "p_size", F.lit(") H("), F.col("p_size") * 2, F.lit(")"))).alias("a"), text.parse_composition(F.lit("C3O")).alias("b"))
    return parsed.select("p_partkey", text.format_composition(text.add_compositions(F.col("a"), F.col("b"))).alias("total"))


@query("peptide_deltas", """SELECT p_partkey, 'PEPMIDEK' AS plain, 2 AS n, round(p_size + 0.5 - 17.25, 4) AS total FROM part""")
def peptide_deltas(t):
    s = F.concat(F.lit("PEPM+"), "p_size", F.lit(".5IDE-17.25K"))
    parsed = t("part").select("p_partkey", text.plain_peptide(s).alias("plain"), text.parse_deltas(s).alias("d"))
    return parsed.select("p_partkey", "plain", F.size("d").alias("n"), F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x["delta"]), 4).alias("total"))


@query("ion_names", """SELECT p_partkey, 'y' || p_size || '-H2O' || CASE WHEN p_size % 3 > 1 THEN '(' || p_size % 3 || '+)' ELSE '' END AS name, 'y' AS series, p_size AS index, '-H2O' AS loss, greatest(1, p_size % 3) AS charge FROM part""")
def ion_names(t):
    name = text.ion_name(F.lit("y"), F.col("p_size"), F.greatest(F.lit(1), F.col("p_size") % 3), F.lit("-H2O"))
    return t("part").select("p_partkey", name.alias("name"), text.parse_ion(name).alias("i")).select("p_partkey", "name", "i.series", "i.index", "i.loss", "i.charge")


@query("tolerance_parse", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, CASE WHEN p_size % 2 = 0 THEN 'ppm' ELSE 'da' END AS unit FROM part""")
def tolerance_parse(t):
    s = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "ppm").otherwise("Da"))
    return t("part").select("p_partkey", mass.tolerance_value(s).alias("value"), mass.tolerance_unit(s).alias("unit"))


@query("native_id_scan", """SELECT event_id, CAST(event_id AS VARCHAR) AS scan FROM events""")
def native_id_scan(t):
    return t("events").select("event_id", text.native_id_value(F.concat(F.lit("controllerType=0 controllerNumber=1 scan="), "event_id"), "scan").alias("scan"))


@query("build_date", """SELECT p_partkey, CAST(DATE '2000-01-01' + CAST(p_partkey % 9000 AS INT) AS DATE) AS built FROM part""")
def build_date(t):
    return t("part").select("p_partkey", text.build_date(F.concat(F.lit("1.0."), F.col("p_partkey") % 9000, F.lit(".7"))).alias("built"))


@query("decoy_reverse", """SELECT p_partkey, 'XXX_' || p_name AS name, reverse(p_name) AS decoy FROM part""")
def decoy_reverse(t):
    return t("part").select("p_partkey", F.concat(F.lit("XXX_"), "p_name").alias("name"), text.decoy_reverse(F.col("p_name")).alias("decoy"))


@query("floor_tiny_values", """SELECT event_id, greatest(9.99e-308, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE value END) AS e_value FROM events""")
def floor_tiny_values(t):
    return t("events").select("event_id", text.floor_tiny(F.when(F.col("event_id") % 2 == 0, F.lit(0.0)).otherwise(F.col("value"))).alias("e_value"))


@query("cleavable_sites", """SELECT p_partkey, substr(p_name, 3, 1) IN ('r', 'k', 'e') AS cuts FROM part""")
def cleavable_sites(t):
    return t("part").select("p_partkey", text.cleavable(F.col("p_name"), 3, "rke").alias("cuts"))


LETTERS = "upper(replace(p_name, ' ', ''))"


@query("residue_masses", f"""WITH r(r, m) AS (VALUES {', '.join(f"('{r}', {m!r})" for r, m in mass.RESIDUE_MASS.items())}),
c AS (SELECT p_partkey, unnest(string_split({LETTERS}, '')) AS l FROM part) SELECT p_partkey, round(sum(coalesce(m, 0)), 5) AS residue_mass FROM c LEFT JOIN r ON r = l GROUP BY p_partkey""")
def residue_masses(t):
    seq = F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("")))
    return t("part").select("p_partkey", F.round(mass.residue_mass(seq), 5).alias("residue_mass"))


@query("residue_atoms", f"""WITH r(r, c, h, n, o, s) AS (VALUES {', '.join(f"('{r}', {', '.join(map(str, a))})" for r, a in mass.RESIDUES.items())}),
l AS (SELECT p_partkey, unnest(string_split({LETTERS}, '')) AS l FROM part)
SELECT p_partkey, CAST(coalesce(sum(c), 0) AS BIGINT) AS "C", CAST(coalesce(sum(h), 0) AS BIGINT) AS "H", CAST(coalesce(sum(n), 0) AS BIGINT) AS "N", CAST(coalesce(sum(o), 0) AS BIGINT) AS "O", CAST(coalesce(sum(s), 0) AS BIGINT) AS "S" FROM l LEFT JOIN r ON r = l GROUP BY p_partkey""")
def residue_atoms(t):
    seq = F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("")))
    return t("part").select("p_partkey", mass.residue_atoms(seq).alias("a")).select("p_partkey", "a.*")


@query("averagine_atoms", """SELECT p_partkey, CAST(round_even(p_retailprice * 20 / w * 4.9384, 0) AS BIGINT) AS "C", CAST(round_even(p_retailprice * 20 / w * 1.3577, 0) AS BIGINT) AS "N" FROM part,
  (SELECT 4.9384::DOUBLE * 12.0 + 7.7583::DOUBLE * 1.007825035 + 1.3577::DOUBLE * 14.003074 + 1.4773::DOUBLE * 15.99491463 + 0.0417::DOUBLE * 31.9720707 AS w)""")
def averagine_atoms(t):
    return t("part").select("p_partkey", mass.averagine_atoms(F.col("p_retailprice") * 20).alias("a")).select("p_partkey", "a.C", "a.N")


PAIRS = """(SELECT a.vec_id, list_transform(a.embedding, lambda x: abs(x)::DOUBLE) AS x, list_transform(b.embedding, lambda x: abs(x)::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _pairs(t, signed=False):
    e = t("embeddings")
    positive = lambda c: c if signed else F.abs(c)
    a = e.select("vec_id", F.transform("embedding", lambda v: positive(v.cast("double"))).alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda v: positive(v.cast("double"))).alias("y"))
    return a.join(b, "vec_id")


@query("envelope_cosine", f"""SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS cosine, round(list_inner_product(x, y), 6) AS dot FROM {PAIRS}""")
def envelope_cosine(t):
    return _pairs(t).select("vec_id", F.round(arrays.cosine(F.col("x"), F.col("y")), 6).alias("cosine"), F.round(arrays.dot(F.col("x"), F.col("y")), 6).alias("dot"))


@query("envelope_pearson", """WITH p AS (SELECT vec_id, unnest(x) AS x, unnest(y) AS y FROM (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1))
SELECT vec_id, round(greatest(0.0, corr(x, y)), 6) AS pearson FROM p GROUP BY vec_id""")
def envelope_pearson(t):
    return _pairs(t, True).select("vec_id", F.round(arrays.pearson(F.col("x"), F.col("y")), 6).alias("pearson"))


@query("envelope_bhattacharyya", f"""WITH p AS (SELECT vec_id, unnest(x) AS x, unnest(y) AS y, list_sum(x) AS sx, list_sum(y) AS sy FROM {PAIRS})
SELECT vec_id, round(-ln(sum(sqrt(x * y)) / sqrt(min(sx) * min(sy))), 6) AS distance FROM p GROUP BY vec_id""")
def envelope_bhattacharyya(t):
    return _pairs(t).select("vec_id", F.round(arrays.bhattacharyya(F.col("x"), F.col("y")), 6).alias("distance"))


@query("kl_divergence", f"""WITH p AS (SELECT vec_id, unnest(x) + 0.001 AS x, unnest(y) + 0.001 AS y FROM {PAIRS}) SELECT vec_id, round(sum(x * ln(x / y)), 6) AS kl FROM p GROUP BY vec_id""")
def kl_divergence(t):
    plus = lambda c: F.transform(c, lambda v: v + 0.001)
    return _pairs(t).select("vec_id", F.round(arrays.kl_divergence(plus("x"), plus("y")), 6).alias("kl"))


@query("envelope_top3", """SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax, round(list_sum(list_slice(embedding::DOUBLE[], greatest(list_position(embedding, list_max(embedding)) - 1, 1), greatest(list_position(embedding, list_max(embedding)) - 1, 1) + 2)), 6) AS top3 FROM embeddings""")
def envelope_top3(t):
    d = F.transform("embedding", lambda v: v.cast("double"))
    return t("embeddings").select("vec_id", arrays.argmax(F.col("embedding")).cast("long").alias("argmax"), F.round(arrays.total(arrays.top3_window(d)), 6).alias("top3"))


@query("reference_intensity", """SELECT vec_id, list_sort(embedding)[least(CAST(floor(len(embedding) * 0.875) AS INT) + 1, len(embedding))] AS reference, list_sort(embedding, 'DESC')[CAST(floor(len(embedding) / 2) AS INT) + 1] AS median FROM embeddings""")
def reference_intensity(t):
    return t("embeddings").select("vec_id", arrays.upper_quantile(F.col("embedding")).alias("reference"), arrays.upper_median(F.col("embedding")).alias("median"))


@query("max_normalised_envelope", """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / list_max(embedding)::DOUBLE)), 4) AS total, CAST(len(list_filter(embedding::DOUBLE[], lambda x: x / list_max(embedding)::DOUBLE >= 0.1)) AS BIGINT) AS n_isotopes FROM embeddings""")
def max_normalised_envelope(t):
    d = F.transform("embedding", lambda v: v.cast("double"))
    n = t("embeddings").select("vec_id", arrays.max_normalised(d).alias("n"))
    return n.select("vec_id", F.round(arrays.total(F.col("n")), 4).alias("total"), F.size(F.filter("n", lambda v: v >= 0.1)).cast("long").alias("n_isotopes"))


@query("max_subarray", """WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
p AS (SELECT *, sum(x) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM v),
m AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM p)
SELECT vec_id, round(max(s - low), 6) AS best FROM m GROUP BY vec_id""")
def max_subarray(t):
    return t("embeddings").select("vec_id", F.round(arrays.max_subarray(F.col("embedding"))["best"], 6).alias("best"))


@query("uniprot_like_frequency", """SELECT l AS letter, count(*) AS n FROM (SELECT unnest(string_split(upper(replace(p_name, ' ', '')), '')) AS l FROM part) GROUP BY l""")
def uniprot_like_frequency(t):
    letters = F.filter(F.split(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit(""))), ""), lambda r: r != "")
    return t("part").select(F.explode(letters).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))


@query("array_to_string", """SELECT vec_id, array_to_string(list_slice(list_transform(embedding, lambda x: CAST(floor(x * 100) AS BIGINT)), 1, 5), chr(9)) AS dump FROM embeddings""")
def array_to_string(t):
    return t("embeddings").select("vec_id", F.array_join(F.slice(F.transform("embedding", lambda x: F.floor(x * 100).cast("string")), 1, 5), "\t").alias("dump"))


@query("metadata_only_projection", """SELECT o_orderkey AS scan_num, o_orderpriority AS activation FROM orders WHERE o_orderkey BETWEEN 100 AND 5000 AND o_orderstatus = 'O'""")
def metadata_only_projection(t):
    return t("orders").where(F.col("o_orderkey").between(100, 5000) & (F.col("o_orderstatus") == "O")).select(F.col("o_orderkey").alias("scan_num"), F.col("o_orderpriority").alias("activation"))


@query("quality_filters", """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE NOT (l_discount > 0.06) AND l_linenumber > 1 AND l_extendedprice / greatest(l_quantity, 1) >= 1000""")
def quality_filters(t):
    return t("lineitem").where(~(F.col("l_discount") > 0.06) & (F.col("l_linenumber") > 1) & (F.col("l_extendedprice") / F.greatest(F.col("l_quantity"), F.lit(1.0)) >= 1000)).select("l_orderkey", "l_partkey", "l_linenumber")


@query("peak_array_filter", """SELECT l_orderkey, len(list_filter(list(l_extendedprice), lambda x: x BETWEEN 20000 AND 50000)) AS n_inside, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def peak_array_filter(t):
    spectra = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("peaks"), F.count("*").alias("n"))
    return spectra.select("l_orderkey", F.size(F.filter("peaks", lambda p: p.between(20000, 50000))).cast("long").alias("n_inside"), "n")
