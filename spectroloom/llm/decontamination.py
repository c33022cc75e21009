"""Benchmark decontamination over a positional inverted index, with DataFrame operations only.

1. Documents are cut into words once and written; all that follows reads the words.
2. Test items are cut into windows (phrases) of consecutive words, each with a number; equal ones are one phrase.
3. Corpus frequencies of all words of the items are counted over all documents.
4. The index is built: the postings (document, term, position) of the rarest terms of each phrase, those of the
   rarest one with the words around them. Words that no phrase is looked up by are left out of the stored index.
5. A phrase is looked up from its rarest terms: each list of postings is shifted back by the term's offset in the
   phrase, so that it holds starts, and the lists are intersected by document, phrase and start. What is left is
   compared word by word with the words around the rarest term, so that no document moves.
6. ``proximity`` looks up phrases whose terms all stand near the rarest one, in any order.

Phrases travel as numbers; the items of a phrase are joined at the end. Terms meet the words of documents by broadcast,
in pieces of bounded size; other test-side tables are broadcast only after their rows, of a bounded number of words, were
counted, and larger ones are joined by hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectroloom.llm.common import ascii_lower, free, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a test-side table (a word or a phrase of a window's words each) up to which it may be broadcast.
BROADCAST_ROWS = 100_000
#: Of how many of a phrase's rarest terms lists are intersected before documents are looked at.
LISTS = 2


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, ASCII letters and all non-ASCII characters; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _looked(words_of: DataFrame, table: DataFrame, on: str = "term") -> DataFrame:
    """``words_of`` joined with ``table``, which is broadcast in pieces of about BROADCAST_ROWS rows, one after the
    other: rows that carry a document's words are never shuffled, however many terms there are."""
    pieces = -(-table.count() // max(1, BROADCAST_ROWS)) or 1
    kept = written(table.withColumn("_piece", F.pmod(F.xxhash64(on), F.lit(pieces)))) if pieces > 1 else table.withColumn("_piece", F.lit(0))
    return reduce(DataFrame.union, [words_of.join(F.broadcast(kept.where(F.col("_piece") == k).drop("_piece")), on) for k in range(pieces)])


def tokenised(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, w): the words of each document, written."""
    return written(docs.select(*keys, words(F.col(text)).alias("w")))


def phrases(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pid, phrase) and (pid, item): the distinct windows, and whose they are; an item of fewer words is one window."""
    cut = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    each = written(cut.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("phrase")).distinct())
    # numbers stay what they are because they are written
    numbered = written(each.select("phrase").distinct().withColumn("pid", F.monotonically_increasing_id()))
    return numbered, written(each.join(numbered, "phrase").select("pid", "item"))


def frequencies(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n): occurrences in all documents of the terms of ``vocabulary``."""
    return _looked(tokens.select(F.explode("w").alias("term")), vocabulary).groupBy("term").agg(F.count("*").alias("n"))


def rarest(found: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """Each phrase with ``rare``: (n, term, offset from 0) of its rarest terms, the rarest first; phrases with a term
    that occurs nowhere are left out, as they occur nowhere."""
    terms = found.select("pid", F.posexplode("phrase").alias("offset", "term"))
    ranked = terms.join(counts, "term", "left").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("r"))
    return ranked.where(F.col("r")[0]["n"] > 0).select("pid", F.slice("r", 1, lists).alias("rare")).join(found, "pid")


def build_index(tokens: DataFrame, terms: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """The stored postings of ``terms`` (term, first): (keys, term, pos, from, near), positions counted in words from 0.

    ``near`` are the words from position ``from`` on, up to ``reach`` on either side of ``pos``; null where ``first`` is false.
    """
    each = _looked(tokens.select(*keys, "w", F.posexplode("w").alias("pos", "term")), terms)
    low = F.greatest(F.lit(0), F.col("pos") - reach)
    return written(each.select(*keys, "term", "pos", low.alias("from"), F.when(F.col("first"), F.slice("w", low + 1, F.col("pos") - low + 1 + reach)).alias("near")))


def exact(index: DataFrame, looked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, length, pid) of every occurrence of the phrases."""
    lists = looked.select("pid", F.size("rare").alias("lists"), F.posexplode("rare").alias("k", "r"))
    lists = lists.select("pid", "lists", F.call_function("shiftleft", F.lit(1), F.col("k")).alias("list"), F.col("r.term").alias("term"), F.col("r.offset").alias("offset"))
    starts = index.select(*keys, "term", "pos").join(_small(lists), "term").select(*keys, "pid", (F.col("pos") - F.col("offset")).alias("start"), "lists", "list").where("start >= 0")
    met = starts.groupBy(*keys, "pid", "start").agg(F.bit_or("list").alias("seen"), F.first("lists").alias("lists"))
    kept = met.where(F.col("seen") == F.call_function("shiftleft", F.lit(1), F.col("lists")) - 1).drop("seen", "lists")
    first = looked.select("pid", "phrase", F.col("rare")[0]["offset"].alias("offset"))
    kept = kept.join(_small(first), "pid").select(*[F.col(k).alias(f"{k}_of") for k in keys], "pid", "start", "phrase", (F.col("start") + F.col("offset")).alias("at"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]) & (F.col("pos") == F.col("at"))
    inside = F.slice("near", F.col("start") - F.col("from") + 1, F.size("phrase")) == F.col("phrase")
    return index.where("near is not null").join(kept, same).where(inside).select(*keys, "start", F.size("phrase").alias("length"), "pid")


def proximity(index: DataFrame, looked: DataFrame, keys: list[str], within: int) -> DataFrame:
    """(keys, pos, pid): postings of a phrase's rarest term with all of its terms within ``within`` words, in any order.

    ``index`` holds the postings of all terms of the phrases. Terms meet the rarest one by document, term and a
    bucket of positions, so that long lists are not paired with each other.
    """
    width = max(1, within)
    first = looked.select("pid", F.col("rare")[0]["term"].alias("term"), F.array_distinct("phrase").alias("terms"))
    seeds = index.join(_small(first), "term").select(*keys, "pid", F.col("pos").alias("at"), "terms")
    near = F.explode(F.array(*[F.floor(F.col("at") / width) + d for d in (-1, 0, 1)]))
    wanted = seeds.select(*keys, "pid", "at", F.size("terms").alias("n"), F.explode("terms").alias("term")).withColumn("bucket", near)
    have = index.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("term").alias("term_of"), "pos", F.floor(F.col("pos") / width).alias("bucket_of"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    met = wanted.join(have, reduce(lambda a, b: a & b, same) & (F.col("term") == F.col("term_of")) & (F.col("bucket") == F.col("bucket_of"))).where(F.abs(F.col("pos") - F.col("at")) <= within)
    seen = met.groupBy(*keys, "pid", "at").agg(F.count_distinct("term").alias("seen"), F.first("n").alias("n"))
    return seen.where("seen = n").select(*keys, F.col("at").alias("pos"), "pid")


def looked_up(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """The phrases that can occur, with their rarest terms over all documents; written."""
    vocabulary = found.select(F.explode("phrase").alias("term")).distinct()
    return written(rarest(found, written(frequencies(tokens, vocabulary))))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items, contaminated.

    A word is hit if it lies inside any occurrence of a window of an item; a document is
    contaminated if it has hits and ``share * n_hit >= n_words``. Null and empty texts have no
    words and no hits, items without words no windows. Rows are told apart by id and text, so
    repeated rows get equal results and a null id is a value. Items with a null id hit but are not
    listed. Either table may be empty; other columns are ignored.
    """
    keys = ["_id", "_hash"]
    tokens = tokenised(docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")), keys, "_text")
    found, owners = phrases(items, window, item_id, item_text)
    looked = looked_up(tokens, found)
    rare = looked.select(F.posexplode("rare.term").alias("k", "term"))
    index = build_index(tokens, rare.groupBy("term").agg(F.bool_or(F.col("k") == 0).alias("first")), keys, window - 1)
    hits = written(exact(index, looked, keys).distinct())
    per_doc = hits.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    whose = hits.select(*keys, "pid").distinct().join(_small(owners), "pid").groupBy(*keys).agg(F.collect_set("item").alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def cover(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["upto"], x["start"]))).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    hit = per_doc.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), F.aggregate("spans", zero, cover)["n"].cast("long").alias("n_hit"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_hash"))
    hit = written(hit.join(whose, same, "left").select("_i", "_h", "n_hit", "items"))
    joined = tokens.select(*keys, F.size("w").cast("long").alias("n_words")).join(hit, same, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(F.col("_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast(hit.schema["items"].dataType)).alias("items"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), F.col("_hash").alias("text_hash"))


def clean(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows, all columns as they were, whatever they are called."""
    id_, hash_ = free(docs, "_id", "_hash")
    bad = written(contamination(docs, items, window, share, doc_id, text).where("contaminated").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct())
    return docs.join(_small(bad), F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_)), "left_anti")
