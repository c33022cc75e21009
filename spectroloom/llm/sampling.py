"""Bounded samples of labelled rows, on which classifiers are fitted.

A sample of k of n ids is drawn in two steps: ids whose hash falls below 2 k / n (all, if n is
small), then the k first of those in hash order. So a task sends its share of about 2 k keys to
the driver, however many tasks there are, and reruns draw the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 1 << 30


def _place(key: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(PLACES))


def _drawn(rows: DataFrame, key: str, n: int, k: int, seed: int) -> DataFrame:
    place = _place(key, seed)
    # 64 more than twice as many: small samples do not run short by chance
    below = min(PLACES, (2 * k + 64) * PLACES // max(1, n))
    return rows.where(place < below).orderBy(place, key).limit(k)


def _texts(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, max_chars: int) -> list[tuple]:
    """[(label, text)] of these ids, which were drawn to a bound, in a fixed order; of rows with equal ids the least text counts."""
    joined = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where(F.col("_text").isNotNull() & (F.length("_text") <= max_chars))
    rows = joined.join(F.broadcast(ids.distinct()), F.col("_doc") == F.col("_id"))
    found = rows.groupBy("_label", "_id").agg(F.min("_text").alias("_text")).collect()
    return [(r["_label"], r["_text"]) for r in sorted(found, key=lambda r: (r["_id"], r["_label"], r["_text"]))]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, eligible: Column, per_class: int, max_chars: int, seed: int, doc_id: str = "doc_id", text: str = "text") -> tuple[list[tuple[int, str]], dict[int, int]]:
    """[(label, text)] of at most ``per_class`` ids of each of the classes 0 and 1, and how many
    eligible rows each class has: a sample of equal classes is weighed back to their true shares.

    The ids are drawn from the label table alone, so the broadcast side of the join with the texts
    holds at most ``2 * per_class`` of them. Texts above ``max_chars`` are not used for fitting, and of
    rows with equal ids one is, which bounds the driver's memory. An id with both labels counts in both classes; null ids, texts and labels, and labels
    other than 0 and 1, are left out. Without labels the sample is empty.
    """
    rows = labels.where(eligible & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).alias("_label"))
    # about how many ids there are thins them out; k of twice as many are wanted, so that a rough count does
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("_label").agg(F.count("*"), F.approx_count_distinct("_id")).collect()}
    drawn = [_drawn(rows.where(F.col("_label") == c).distinct(), "_id", sizes.get(c, (0, 0))[1], per_class, seed) for c in (0, 1)]
    return _texts(docs, drawn[0].union(drawn[1]), doc_id, text, max_chars), {c: n for c, (n, _) in sizes.items()}


def class_weights(labels: list[int], totals: dict[int, int] | None) -> list[float]:
    """A weight for each row of a sample, so that classes weigh as their totals (1 each without them); their mean is 1."""
    if not totals or not labels:
        return [1.0] * len(labels)
    drawn = {c: labels.count(c) for c in set(labels)}
    raw = [totals.get(c, drawn[c]) / drawn[c] for c in labels]
    mean = sum(raw) / len(raw)
    return [w / mean for w in raw]


def documents_sample(docs: DataFrame, group: str, eligible: Column, per_group: int, max_chars: int, seed: int, doc_id: str = "doc_id", text: str = "text") -> dict[str, list[str]]:
    """At most ``per_group`` ids' texts for every value of ``group`` among eligible rows.

    Texts above ``max_chars`` are used only where a group has no other: their first ``max_chars`` characters.
    Of rows with equal ids and groups one is used, that of the least text; rows with a null id, text or group are left out.
    """
    fit = docs.where(eligible & F.col(doc_id).isNotNull() & F.col(text).isNotNull() & F.col(group).isNotNull())
    fit = fit.select(F.col(doc_id).alias("_id"), F.col(group).alias("_label"), F.col(text).alias("_text"), (F.length(text) > max_chars).alias("_long"))
    # a row for each group: about how many ids it draws from, and whether their texts are long ones
    ids = F.approx_count_distinct(F.when(~F.col("_long"), F.col("_id"))).alias("short"), F.approx_count_distinct("_id").alias("n")
    sizes = fit.groupBy("_label").agg(*ids).collect()
    if not sizes:
        return {}
    bounds = [(r["_label"], not r["short"], min(PLACES, (2 * per_group + 64) * PLACES // (r["short"] or r["n"]))) for r in sizes]
    drawn_from = docs.sparkSession.createDataFrame(bounds, f"_label {fit.schema['_label'].dataType.simpleString()}, _long boolean, _below long")
    usable = fit.join(F.broadcast(drawn_from), ["_label", "_long"])
    # the same rows as _drawn takes, for all groups at once: about 2 per_group of a group meet
    below = usable.where(_place("_id", seed) < F.col("_below"))
    rank = F.row_number().over(Window.partitionBy("_label").orderBy(_place("_id", seed), "_id"))
    ids = below.select("_label", "_long", "_id").distinct().withColumn("_rank", rank).where(F.col("_rank") <= per_group).drop("_rank")
    rows = usable.join(F.broadcast(ids), ["_label", "_long", "_id"], "left_semi").groupBy("_label", "_id").agg(F.min(F.left("_text", F.lit(max_chars))).alias("_text"))
    out: dict[str, list[str]] = {r["_label"]: [] for r in sizes}
    for r in sorted(rows.collect(), key=lambda r: (r["_id"], r["_label"], r["_text"])):
        out[r["_label"]].append(r["_text"])
    return out
