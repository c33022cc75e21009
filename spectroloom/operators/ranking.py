"""Bounded top-k and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_k_distinct_scores(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[Column], k: int) -> DataFrame:
    """The k best rows of each group, one for each score."""
    one = Window.partitionBy(*keys, score).orderBy(*tie)
    return top_k(df.withColumn("_one", F.row_number().over(one)).where("_one = 1").drop("_one"), keys, [F.col(score).desc()], k)


def top_k_with_ratio(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[Column], k: int, ratio: float = 0.7) -> DataFrame:
    """The k best rows of each group that reach ``ratio`` times its best score."""
    most = F.max(score).over(Window.partitionBy(*keys))
    return top_k(df.withColumn("_m", most).where(F.col(score) >= F.col("_m") * ratio).drop("_m"), keys, [F.col(score).desc(), *tie], k)


def top_n_with_ties(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[Column], n: int) -> DataFrame:
    """The n best rows of each group by ascending score, and beyond n those that equal the first."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).asc(), *tie)
    first = F.min(score).over(Window.partitionBy(*keys))
    return df.withColumn("place", F.row_number().over(w)).withColumn("_f", first).where((F.col("place") <= n) | (F.col(score) == F.col("_f"))).drop("_f")


def nearest_n(df: DataFrame, keys: Sequence[str], at: str, target: str, tie: Sequence[Column], n: int) -> DataFrame:
    return top_k(df, keys, [F.abs(F.col(at) - F.col(target)).asc(), *tie], n)


def sorted_by(df: DataFrame, by: str, *more: str) -> DataFrame:
    """A global order that spills: ranges across partitions, sorted within."""
    return df.repartitionByRange(by).sortWithinPartitions(by, *more)
