"""Merkle manifests of data sets: a digest for each row, a root for each source and for all, and proofs.

1. Rows are put in order by ranges of (source, order); a table with a row for each range and source says where
   a source starts in each range, so that a row's position needs no window over a whole source.
2. Nodes are dealt into blocks of ``ARITY ** HEIGHT`` neighbours. Within a block every level is the same window:
   columns of a fixed lag and lead, masked by the slot of a node in its run and the length of the run, are its
   siblings, and the row of a run's first child hashes the parent. A block takes one shuffle for all its levels.
3. The tops of the blocks are the nodes of the next pass, until one node a source is left. The sources' roots,
   in order, go the same way.
4. Siblings come down again from the last pass to the first: blocks are joined with the paths of their tops.

DataFrame functions only. Digests are lowercase hexadecimal text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectroloom.llm.common import fanout, written

ARITY = 3
#: Levels of a block: it has ARITY ** HEIGHT = 2187 nodes.
HEIGHT = 7
#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def digest(*inputs: Column) -> Column:
    """SHA-256 of the concatenated inputs."""
    return F.sha2(F.concat(*inputs), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: of each field ``-`` if it is null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(path, start, lambda node, level: digest(level["left"], node, level["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right (none: of the empty text)."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows``, which have ``tree`` (not null), with ``pos`` from 0 in ``order`` within its tree and ``n``, the rows of the tree."""
    parts = max(fanout(rows.sparkSession), rows.count() // RANGE_ROWS)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = written(rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).select("*", F.spark_partition_id().alias("range"), within.alias("at")))
    runs = ranged.groupBy("range", "tree").agg(F.count("*").alias("rows"), F.min("at").alias("low"))
    earlier = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("range", "tree", "low", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return ranged.join(starts, ["range", "tree"]).withColumn("pos", F.col("before") + F.col("at") - F.col("low")).drop("range", "at", "low", "before")


def climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, n, node, ...) with ``block``, ``path`` (siblings within the block, level by level) and, where
    a block begins, ``node`` as the block's top."""
    whole = ARITY**HEIGHT
    block = Window.partitionBy("tree", "block").orderBy("pos")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = nodes.withColumn("block", F.expr(f"pos div {whole}"))
    for k in range(HEIGHT):
        step = ARITY**k
        count, at = F.expr(f"(n + {step - 1}) div {step}"), F.expr(f"pos div {step}")
        out = out.select(
            "*", count.alias("count"), (at % ARITY).alias("slot"), *[F.lag("node", d * step).over(block).alias(f"back{d}") for d in range(1, ARITY)], *[F.lead("node", d * step).over(block).alias(f"ahead{d}") for d in range(1, ARITY)],
            F.least(F.lit(ARITY), count - at + at % ARITY).alias("run"),
        )
        left = F.concat(*[F.when(F.col("slot") >= d, F.col(f"back{d}")).otherwise("") for d in range(ARITY - 1, 0, -1)])
        right = F.concat(*[F.when(F.col("slot") + d < F.col("run"), F.col(f"ahead{d}")).otherwise("") for d in range(1, ARITY)])
        # only the first leaf of a node stands for it
        siblings = F.when((F.col("pos") % step == 0) & (F.col("count") > 1), F.struct(left.alias("left"), right.alias("right")))
        out = out.withColumn(f"level{k}", siblings)
        parent = F.when(F.col("pos") % (step * ARITY) == 0, digest(F.col("node"), F.col(f"level{k}.right")))
        out = out.withColumn("node", F.when(F.col("count") > 1, parent).otherwise(F.col("node")))
        out = out.drop("count", "slot", "run", *[f"{way}{d}" for way in ("back", "ahead") for d in range(1, ARITY)])
    levels = [f"level{k}" for k in range(HEIGHT)]
    out = out.select(*[c for c in out.columns if c not in levels], *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in levels])
    return out.withColumn("path", F.filter(F.array(*levels), lambda level: level.isNotNull())).drop(*levels)


def _passes(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The passes from the leaves up, and (tree, node): the root of each tree."""
    passes = []
    while True:
        passes.append(climbed(nodes))
        tops = passes[-1].where(F.expr(f"pos % {ARITY**HEIGHT} = 0"))
        nodes = written(tops.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {ARITY**HEIGHT - 1}) div {ARITY**HEIGHT}").alias("n"), "node"))
        if not nodes.where("n > 1").limit(1).count():
            return passes, nodes.select("tree", "node")


def _down(passes: list[DataFrame], above: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The rows of the first pass with ``keep`` and their whole paths; ``above`` has (tree, path, keep) for each tree."""
    above = above.withColumn("pos", F.lit(0).cast("long"))
    for k, low in reversed(list(enumerate(passes))):
        top = above.select(F.col("tree").alias("tree_of"), F.col("pos").alias("block_of"), F.col("path").alias("path_of"), *keep)
        met = low.join(top, (F.col("tree") == F.col("tree_of")) & (F.col("block") == F.col("block_of")))
        above = met.withColumn("path", F.concat("path", "path_of")).drop("tree_of", "block_of", "path_of", "block", "node", "n")
        above = written(above) if k else above
    return above


def manifest(rows: DataFrame, leaf: str = "leaf", source: str = "source", order: str = "doc_id") -> DataFrame:
    """``rows`` with ``path`` (array of left and right: the siblings of every level, one text each), ``subroot`` (of
    the row's source) and ``root``, replaced if there.

    Leaves ascend by ``order``, nulls first, rows of equal order by their digest, so that reruns agree; repeated
    rows are leaves of their own. A null source is a source and comes first. A source of one row has that leaf as
    its subroot, one source's subroot is the root. Null digests are taken as empty text. Texts of any length only
    enter by their digests. Other columns stay, whatever they are called; an empty table gives no rows.
    """
    rows = rows.drop("path", "subroot", "root")
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    first = written(rows.select(key.alias("tree"), F.col(order).alias("order"), F.coalesce(leaf, F.lit("")).alias("node"), F.struct("*").alias("row")))
    passes, subroots = _passes(written(numbered(first, ["order", "node"]).drop("order")))
    sources = written(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"))
    over, root = _passes(written(numbered(sources, ["source"]).withColumn("subroot", F.col("node"))))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    tops = _down(over, root.select("tree", empty.alias("path"), F.col("node").alias("root")), ["root"])
    done = _down(passes, written(tops.select(F.col("source").alias("tree"), "path", "subroot", "root")), ["subroot", "root"])
    return done.select("row.*", "path", "subroot", "root")
