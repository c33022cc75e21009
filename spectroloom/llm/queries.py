"""The queries opN_<name> over whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.llm import chat, decontamination, language, licenses, media, merkle, minhash, mixing, periods, quality, simhash, substrings, toxicity
from spectroloom.llm.common import WORD, crc_mod, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, t.turn, t.role, '{text}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    done = chat.format_conversations(turns.unionByName(extra))
    read = done.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.under_loss(F.col("segments")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2', 'g') AS erole,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2', 'g') AS etext,
    lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS first,
    lead(role) OVER w IS DISTINCT FROM role OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + CASE WHEN first THEN 16 + length(erole) ELSE 8 END + CASE WHEN last THEN 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, crc_mod("doc_id", 3) != 1)
    done = quality.scored(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", quality.predicted().alias("predicted"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = licenses.scan(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text_digest", "text_license", "n_lines", F.array_join("line_licenses", ",").alias("line_licenses"))


def _op4_sql() -> str:
    """The rules are written out here once more, in DuckDB's functions, from the operator's description and not from its patterns."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    equal = """acknowledgement>acknowledgment analogue>analog analyse>analyze artefact>artifact authorisation>authorization authorised>authorized calibre>caliber cancelled>canceled
      capitalisations>capitalizations catalogue>catalog categorise>categorize centre>center copyright_owner>copyright_holder emphasised>emphasized favour>favor favourite>favorite fulfil>fulfill
      fulfilment>fulfillment https>http initialise>initialize judgement>judgment labelling>labeling labour>labor licence>license maximise>maximize merchantibility>merchantability modelled>modeled
      modelling>modeling noncommercial>non_commercial noninfringement>non_infringement offence>offense optimise>optimize organisation>organization organise>organize per_cent>percent practise>practice
      programme>program realise>realize recognise>recognize signalling>signaling sub_license>sublicense sub_licence>sublicense sublicence>sublicense utilisation>utilization whilst>while wilful>willful"""
    # marks that are not part of a word, and what stands between the parts of a notice
    gap = r"[\x00-\x20\x{00a0}!\"#$%&''()*+,./:;<=>?@\[\\\]^_`{|}~“”‘’–—-]"
    year_or_holder = r"([\[{<]|\d)"
    sign = r"(\(c\)|©)"
    head, some = r"^[^0-9a-z]*", r"[ \t\r,]*"
    notices = [f"{head}copyright[ \t\r:,]*({sign}|&copy;|{year_or_holder}|by\b)", f"{head}{sign}{some}(copyright|{year_or_holder})", f"{head}all rights reserved[^0-9a-z]*$"]
    is_notice = " OR ".join(f"regexp_matches(x, '{n}')" for n in notices)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    kept = f"list_filter(string_split({lower}, chr(10)), lambda x: NOT ({is_notice}))"
    words = f"list_filter(string_split_regex(T, '{gap}+'), lambda w: w <> '')"
    spelled = f"' ' || array_to_string({words}, '  ') || ' '"
    for pair in equal.split():
        old, new = (f"' {x.replace('_', '  ')} '" for x in pair.split(">"))
        spelled = f"replace({spelled}, {old}, {new})"
    form = f"trim(replace({spelled}, '  ', ' '))"
    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in [*licenses.KNOWN, *licenses.license_texts()])
    return f"""
WITH t AS (SELECT license, array_to_string({kept}, chr(10)) AS T FROM (VALUES {known}) AS v(license, text)),
k AS (SELECT min(license) AS license, sha256({form}) AS digest FROM t GROUP BY 2),
d AS (SELECT doc_id, {kept} AS l FROM documents),
w AS (SELECT doc_id, sha256({form}) AS text_digest FROM (SELECT doc_id, array_to_string(l, chr(10)) AS T FROM d)),
u AS (SELECT doc_id, license FROM (SELECT doc_id, sha256({form}) AS digest FROM (SELECT doc_id, unnest(l) AS T FROM d)) JOIN k USING (digest)),
n AS (SELECT doc_id, count(*) AS n_lines, string_agg(DISTINCT license, ',' ORDER BY license) AS ids FROM u GROUP BY doc_id)
SELECT w.doc_id, text_digest, k.license AS text_license, coalesce(n_lines, 0) AS n_lines, coalesce(ids, '') AS line_licenses
FROM w LEFT JOIN k ON k.digest = w.text_digest LEFT JOIN n USING (doc_id)
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, crc_mod("doc_id", 3) != 1)
    done = language.identified(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.without_repeats(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS p FROM d, range(1, len(w) - 48) AS r(i) WHERE len(w) >= 50),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY p) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM dup, range(0, 50) AS r(k)),
lists AS (SELECT doc_id, count(*) AS n, list(pos) AS ats FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ats, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i:i + 12] AS p, least(len(w), 13) AS n FROM b, range(1, greatest(len(w) - 12, 1) + 1) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS p FROM d, lens, range(1, len(w) - n + 2) AS r(i) WHERE len(w) >= n),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, range(0, 13) AS r(k) WHERE k < m.n GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, crc_mod("doc_id", 5) != 0)
    done = toxicity.scored(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a tenth of the documents (none without an id) repeat some of their words to the end
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.withColumn("g", F.floor(h / 10)).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"))))
    placed = cut.withColumn("a", F.expr("g % size(w)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    told = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    done = periods.with_runs(placed.select("doc_id", F.when(F.size("w") > 0, F.array_join(told, " ")).otherwise(F.col("text")).alias("text")))
    first = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = done.withColumn("best", first)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = lambda text: merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    # a row without an id has no decimal id, and is left as it is
    lost = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    rows = docs.select("doc_id", "source", digest(F.col("text")).alias("leaf"), F.when(lost, digest(F.translate("text", "\n", ""))).alias("changed"))
    done = merkle.manifest(rows).withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return done.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    replace(text, chr(10), '') AS cut,
    list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: CAST(ascii(substr(doc_id::VARCHAR, i, 1)) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
l AS (
  SELECT doc_id, src, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS shorter, xor(crc, 4294967295) % 2 = 0 AS even,
    row_number() OVER (PARTITION BY src ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n
  FROM d),
up AS (
  SELECT src, 0 AS lvl, pos, n, leaf AS h FROM l
  UNION ALL SELECT src, lvl + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY src, lvl, pos // 3),
s AS (SELECT src, h AS subroot, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM s
  UNION ALL SELECT lvl + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
sib AS (
  SELECT src, lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM up WHERE n > 1 WINDOW w AS (PARTITION BY src, lvl, pos // 3 ORDER BY pos)),
topsib AS (
  SELECT lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // 3 ORDER BY pos)),
steps AS (
  SELECT doc_id, lvl, a, b FROM l JOIN sib ON sib.src = l.src AND sib.pos = l.pos // CAST(pow(3, lvl) AS BIGINT)
  UNION ALL SELECT doc_id, 1000 + lvl, a, b FROM l JOIN s USING (src) JOIN topsib ON topsib.pos = s.pos // CAST(pow(3, lvl) AS BIGINT)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lvl) AS i FROM steps),
fold AS (
  SELECT doc_id, 1 AS i, CASE WHEN even THEN shorter ELSE leaf END AS h FROM l
  UNION ALL SELECT doc_id, f.i + 1, sha256(a || h || b) FROM fold f JOIN p USING (doc_id) WHERE p.i = f.i),
proofs AS (SELECT doc_id, sha256(string_agg(a || b, '' ORDER BY i)) AS proof FROM p GROUP BY doc_id),
ends AS (SELECT doc_id, max_by(h, i) AS folded_root FROM fold GROUP BY doc_id),
r AS (SELECT h AS root FROM top WHERE n = 1)
SELECT l.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s USING (src) CROSS JOIN r JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)
"""


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = minhash.near_duplicates(docs)
    return done.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM d, range(1, greatest(len(w) - 3, 1) + 1) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM b JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * m >= 80 * (p.n + q.n - m)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS c FROM reach GROUP BY u) USING (doc_id)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_chat_formatting": op1_chat_formatting,
        "op2_mixing": op2_mixing,
        "op3_quality": op3_quality,
        "op4_licenses": op4_licenses,
        "op5_simhash": op5_simhash,
        "op6_language": op6_language,
        "op7_media": op7_media,
        "op8_substrings": op8_substrings,
        "op9_decontamination": op9_decontamination,
        "op10_toxicity": op10_toxicity,
        "op11_periods": op11_periods,
        "op12_merkle": op12_merkle,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op4_licenses": _op4_sql(), "op8_substrings": OP8_SQL, "op9_decontamination": OP9_SQL, "op12_merkle": OP12_SQL, "op13_minhash": OP13_SQL}
