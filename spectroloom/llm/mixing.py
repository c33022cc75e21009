"""Mixing sources to target weights by subset-sum budget fitting.

1. Targets: sources share a budget by weight; a target stops at ``max_epochs`` times its source's
   size and the excess is shared again (water filling).
2. Whole epochs: ``floor(target / size)`` repeats of every document.
3. The rest of the budget, below one epoch, is fitted over the histogram of exact lengths: each
   length first gives its proportional share of documents, then the largest lengths that still
   fit are added, and a bounded-knapsack dynamic programme finds the combination of the documents
   left over whose sum comes closest to what then remains.
4. Within a length, documents are taken in a seeded order, by counts: no group of equal lengths
   ever meets in one task, only the ids of the one bucket of its order in which the count runs out.
   Texts are read twice, to count and to return them, and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectroloom.llm.common import WORD, written

#: Buckets of the seeded order within a (source, length).
BUCKETS = 256
#: Rows (below 100 bytes each) of the plan up to which it is broadcast.
BROADCAST_ROWS = 200_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[float], weights: Sequence[float], budget: float, cap: float) -> list[float]:
    """Shares of ``budget`` in proportion to ``weights``, none above ``cap`` times its size."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        shares = {i: left * weights[i] / total for i in sorted(open_)}
        over = [i for i in sorted(open_) if shares[i] > cap * sizes[i]]
        if not over:
            for i, share in shares.items():
                targets[i] = share
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
            open_.discard(i)
    return targets


def shared(sources: DataFrame, weights: Sequence[float], budget_share: float, cap: float) -> DataFrame:
    """(source, source_size, target) of a table (source, words): ``water_fill`` as rounds of sums, however many sources there are.

    Sources in code-point order (null last) get ``weights`` in turn; that order is a sort in one task of a row for each source.
    Who is above the cap at one level stays above it at the next, higher one, so that a round needs the level alone.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")) - 1
    each = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    ranked = written(sources.select("source", F.col("words").alias("source_size"), each.alias("weight")))
    budget = budget_share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    left, open_weight, above = float(budget), float(ranked.agg(F.sum("weight")).first()[0] or 0), -1
    capped = F.col("source_size") * float(cap)
    while True:
        # as a share: the same sum in the same order as for a list
        over = (F.lit(left) * F.col("weight") / F.lit(open_weight)) > capped if open_weight > 0 else F.lit(True)
        n, size, weight = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == above or not open_weight:
            return ranked.select("source", "source_size", F.when(over, capped).otherwise(F.lit(left) * F.col("weight") / F.lit(open_weight or 1.0)).alias("target"))
        left, open_weight, above = budget - float(cap) * (size or 0), float(weight or 0), n


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int, dp_words: int = 1 << 16) -> list[int]:
    """How many documents of each length to take so that their words come closest to ``budget``.

    Each length gives its proportional share less one, then the longest documents go in while more
    than the programme's width remains: ``dp_words`` or twice the longest document, whichever is
    more. What then remains is filled with the best sum that all documents left over can make.
    """
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > 0), key=lambda i: -lengths[i])
    total = sum(lengths[i] * counts[i] for i in order)
    take = [0] * len(lengths)
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return [counts[i] if lengths[i] > 0 else 0 for i in range(len(lengths))]
    left, width = budget, max(dp_words, 2 * lengths[order[0]])
    for i in order:
        # one document is held back where it can be, so that the programme has something to choose from
        take[i] = max(0, min(counts[i], budget * counts[i] // total) - 1)
        left -= take[i] * lengths[i]
    for i in order:
        if left < width:
            break
        # half the width is no less than the longest document, so that this ends below the width
        more = min(counts[i] - take[i], max(0, left - width // 2) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    # bounded knapsack over sums up to left: bit s of reach is set if s words can be made; each
    # count is split into powers of two, and the items are walked back from the best sum.
    # Of a sum only the item that first made it is kept: what it was made from came earlier.
    mask, reach, items, made = (1 << (left + 1)) - 1, 1, [], np.zeros(left + 1, np.int32)
    for i in order:
        free = min(counts[i] - take[i], left // lengths[i])
        k = 1
        while free > 0 and not reach >> left & 1:
            k = min(k, free)
            new = reach << k * lengths[i] & mask & ~reach
            reach |= new
            made[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little"))] = len(items)
            items.append((i, k))
            free -= k
            k *= 2
        if reach >> left & 1:
            break
    best = reach.bit_length() - 1
    while best:
        i, k = items[made[best]]
        take[i] += k
        best -= k * lengths[i]
    return take


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget_share: float = 1.5, max_epochs: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    Sources in code-point order (null last) get ``weights`` in turn. Every input row is returned:
    ``taken`` is ``size`` times the document's repeats, 0 if the mix leaves it out. Null and empty
    texts have size 0 and are never worth taking. Rows that agree in id, source and size are
    interchangeable: where a quota ends among them, a hash of their values decides. Columns of the four
    names above are replaced, all others stay, whatever they are called. Reruns agree. An empty table
    gives no rows.
    """
    kept = docs.drop("size", "source_size", "target", "taken")
    # the input's columns travel in one struct, so that no name of theirs can clash
    base = kept.select(F.struct("*").alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.col(doc_id).alias("id"))
    base = base.withColumn("order", F.xxhash64(F.lit(seed), "id"))
    base = base.withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(BUCKETS)).cast("int"))
    # one pass over the texts: what the rest is decided by, without them
    slim = written(base.select("source", "size", "bucket", "order", "id"))
    counted = written(slim.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")))
    histogram = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    spec = shared(sources, weights, budget_share, max_epochs).withColumnRenamed("source", "key")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        epochs = int(target // size) if size else 0
        group = group.sort_values("size")
        group["repeats"] = epochs
        group["extra"] = fit(group["size"].tolist(), group["n"].tolist(), int(round(target)) - epochs * size)
        return group[["source", "size", "source_size", "target", "repeats", "extra"]]

    with_spec = histogram.join(spec, F.col("source").eqNullSafe(F.col("key"))).drop("key")
    plan = written(with_spec.groupBy("source").applyInPandas(fitted, "source string, size long, source_size long, target double, repeats long, extra long"))
    plan = plan.withColumnsRenamed({"source": "of", "size": "words"})
    own = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("words"))
    # of each (source, size) the bucket in which its documents run out, and how many that bucket gives
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counted.withColumn("before", before).join(plan, own).where((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("n")))
    ends = steps.select("of", "words", F.col("bucket").alias("cut"), (F.col("extra") - F.col("before")).alias("quota"))
    # within that bucket the key at which its quota is used up; a key is one document's, unless ids repeat
    keys = slim.join(ends.where("quota > 0"), own & (F.col("bucket") == F.col("cut"))).groupBy("of", "words", "quota", "order", "id").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("of", "words").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0))
    last = keys.withColumn("so_far", so_far).where((F.col("quota") <= F.col("so_far")) & (F.col("so_far") - F.col("n") < F.col("quota")))
    last = last.select("of", "words", F.struct("order", "id").alias("key"), (F.col("quota") - F.col("so_far") + F.col("n")).alias("from_key"), F.col("n").alias("at_key"))
    plan = written(plan.join(ends.drop("quota").withColumnsRenamed({"of": "of1", "words": "words1"}), F.col("of").eqNullSafe(F.col("of1")) & (F.col("words") == F.col("words1")), "left").drop("of1", "words1")
                   .join(last.withColumnsRenamed({"of": "of2", "words": "words2"}), F.col("of").eqNullSafe(F.col("of2")) & (F.col("words") == F.col("words2")), "left").drop("of2", "words2"))
    # a row for each source and length; beyond the bound texts are shuffled to it instead
    joined = base.join(F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan, own)
    at = F.struct("order", "id")
    inside = F.col("cut").isNull() | (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & F.coalesce(at < F.col("key"), F.lit(False)))
    on_key = (F.col("bucket") == F.col("cut")) & F.coalesce(at == F.col("key"), F.lit(False))
    done = lambda rows, chosen: rows.select("row.*", "size", "source_size", "target", (F.col("size") * (F.col("repeats") + chosen.cast("long"))).alias("taken"))
    if not plan.where("from_key < at_key").limit(1).count():
        return done(joined, inside | on_key)
    values = F.xxhash64(*[F.col("row")[f.name] for f in kept.schema.fields if "map" not in f.dataType.simpleString()])
    tied = joined.where(on_key).withColumn("rank", F.row_number().over(Window.partitionBy("of", "words").orderBy(values)))
    return done(joined.where(~on_key), inside).unionByName(done(tied, F.col("rank") <= F.col("from_key")))
