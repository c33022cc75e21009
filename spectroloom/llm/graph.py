"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a map-side combined minimum and a join, which Spark splits where one node has very
many links; each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.llm.common import discard, written


def _towards(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Each link with m, the least of u and all its neighbours v."""
    least = edges.groupBy(u).agg(F.min(v).alias("_m"))
    return edges.join(least.withColumnRenamed(u, "_u"), F.col(u) == F.col("_u")).select(u, v, F.least(u, "_m").alias("m"))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node with a link; root is the least node of its component.

    ``edges`` has two long columns u and v; loops and repeats are harmless, nulls are ignored.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards(both, "u", "v").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _towards(large, "u", "v")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        after = written(small)
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = after
        if state == tuple(seen):
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components: not done after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
