"""The order of all suffixes of a table of sequences, whole, by doubling the length that is compared.

Suffixes are never copied: a row knows its sequence, its start and a rank, which tells the first h residues. Ranks of 2 h
residues come from the ranks at the start and h further on. Only rows whose rank is shared go on, and each round is written,
so that the lengths that suffixes have in common are read from the rounds afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectroloom.operators.scratch import materialised


def _with_sums_before(df: DataFrame, order: list[str], weight: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``weight`` over all rows before in an order without ties.

    Rows are divided into ranges of the order and written; a table with a row for each range carries the sums.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_from"))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # at most ``parts`` rows are broadcast
    joined = ranged.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return joined.withColumn("before", F.col("_from") + F.coalesce(F.sum(weight).over(here), F.lit(0))).drop("_part", "_p", "_from")


def _doubled(heads: DataFrame, head: int) -> list[tuple[int, DataFrame]]:
    """(h, ranks) of each round; a rank is the number of suffixes whose first h residues come earlier, so that equal
    ranks mean equal first h residues (or equal whole suffixes, where they are shorter)."""
    first = _with_sums_before(heads.groupBy("head").agg(F.count("*").alias("c")), ["head"], "c")
    ranks = materialised(heads.join(first.withColumnRenamed("before", "rank"), "head").drop("head"))
    levels, h = [(head, ranks)], head
    while True:
        # ranks that several rows share and that longer prefixes may tell apart
        open_ranks = ranks.where("c > 1").groupBy("rank").agg(F.max("left").alias("_most")).where(F.col("_most") > h).select("rank")
        ahead = ranks.select("row", (F.col("start") - h).alias("start"), F.col("rank").alias("ahead"))
        live = materialised(ranks.join(open_ranks, "rank", "left_semi").join(ahead, ["row", "start"], "left").withColumn("ahead", F.coalesce("ahead", F.lit(-1))).drop("c"))
        if not live.limit(1).count():
            return levels
        keys = materialised(_with_sums_before(live.groupBy("rank", "ahead").agg(F.count("*").alias("c")), ["rank", "ahead"], "c"))
        lows = keys.groupBy("rank").agg(F.min("before").alias("_low"))
        told = keys.join(lows, "rank").select("rank", "ahead", "c", (F.col("rank") + F.col("before") - F.col("_low")).alias("now"))
        moved = live.join(told, ["rank", "ahead"]).drop("rank", "ahead").withColumnRenamed("now", "rank")
        ranks = materialised(moved.unionByName(ranks.join(open_ranks, "rank", "left_anti")))
        h *= 2
        levels.append((h, ranks))


def suffix_array(proteins: DataFrame, protein: str, sequence: str, head: int = 16) -> DataFrame:
    """(protein, start, length, position, common): all suffixes in lexicographic order, of any length.

    ``position`` counts from 1 through the whole order, ``start`` from 1 in the sequence; ``common`` is how many residues
    a suffix shares with the one before it. A suffix comes before those that it begins; equal ones follow by protein (null
    first) and start. Null and empty sequences have no suffixes; rows with one id are sequences of their own; other columns
    are ignored. The first round compares ``head`` residues, each next one twice as many.
    """
    rows = materialised(proteins.where(F.length(sequence) > 0).select(F.col(protein).alias("id"), F.col(sequence).alias("seq")).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("id", "row", "seq", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("start"))
    each = each.select("id", "row", F.col("start").cast("long").alias("start"), (F.length("seq") - F.col("start") + 1).alias("left"), F.substring(F.col("seq"), F.col("start"), F.lit(head)).alias("head"))
    heads = materialised(each)
    levels = _doubled(heads, head)
    order = ["rank", "id", "start", "row"]
    parts = int(proteins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(levels[-1][1].repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    place = F.struct("row", "start")
    ends = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.max_by(place, F.struct(*order)).alias("_last"))
    by_part = Window.partitionBy(F.lit(0)).orderBy("_part")
    ends = ends.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"), F.lag("_last").over(by_part).alias("_end"))
    within = Window.partitionBy("_part").orderBy(*order)
    # one row a range is broadcast
    placed = ranged.join(F.broadcast(ends), F.col("_part") == F.col("_p")).withColumn("_before", F.coalesce(F.lag(place).over(within), "_end"))
    pairs = placed.select("id", "row", "start", "left", (F.col("_from") + F.row_number().over(within)).alias("position"), F.col("_before.row").alias("row_b"), F.col("_before.start").alias("start_b"), F.lit(0).cast("long").alias("common"))

    def beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        """``pairs`` with what a table has at the first places that are not yet compared."""
        at = lambda s: table.select(F.col("row").alias(f"_row{s}"), F.col("start").alias(f"_start{s}"), F.col(column).alias(f"_{s}"))
        own = pairs.join(at("a"), (F.col("row") == F.col("_rowa")) & (F.col("start") + F.col("common") == F.col("_starta")), "left")
        both = own.join(at("b"), (F.col("row_b") == F.col("_rowb")) & (F.col("start_b") + F.col("common") == F.col("_startb")), "left")
        return both.drop("_rowa", "_starta", "_rowb", "_startb")

    pairs = materialised(pairs)
    for h, ranks in reversed(levels):
        step = F.when(F.col("_a") == F.col("_b"), F.least(F.lit(h), F.col("left") - F.col("common"))).otherwise(0)
        pairs = materialised(beside(pairs, ranks, "rank").withColumn("common", F.col("common") + step).drop("_a", "_b"))
    same = lambda i: F.substring(F.col("_a"), i, F.lit(1)) == F.substring(F.col("_b"), i, F.lit(1))
    shorter = F.least(F.length("_a"), F.length("_b"))
    rest = F.when(shorter > 0, F.aggregate(F.sequence(F.lit(1), shorter), F.lit(0), lambda n, i: F.when((n == i - 1) & same(i), i).otherwise(n))).otherwise(0)
    done = beside(pairs, heads, "head").withColumn("common", F.col("common") + F.coalesce(rest, F.lit(0)))
    return done.select(F.col("id").alias(protein), "start", F.col("left").cast("long").alias("length"), "position", "common")


def distinct_substrings(order: DataFrame) -> DataFrame:
    """(length, substrings): how many different substrings of each length there are, read from ``suffix_array``.

    A suffix brings one new substring for each length above what it shares with the one before it. Nothing is enumerated:
    lengths and shared lengths are counted, and the counts are summed from the longest down.
    """
    ends = order.groupBy("length").agg(F.count("*").alias("n")).unionByName(order.where("common > 0").groupBy(F.col("common").alias("length")).agg((-F.count("*")).alias("n")))
    # a row for each length of a sequence, not for each suffix
    lengths = ends.groupBy("length").agg(F.sum("n").alias("n"))
    longer = Window.partitionBy(F.lit(0)).orderBy(F.col("length").desc())
    spans = lengths.select("length", F.sum("n").over(longer).alias("substrings"), F.lag("length", -1, 0).over(longer).alias("_next"))
    return spans.select(F.explode(F.sequence(F.col("_next") + 1, F.col("length"))).alias("length"), "substrings")
