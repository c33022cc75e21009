"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark contamination, mixing.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs.

All stages take null texts as empty, any column may be null, columns beyond those of documents are
dropped, and empty tables pass through. Rows without an id are scored, grouped and mixed like others;
they lose no passages to others and take none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.llm import decontamination, mixing, quality, simhash, substrings
from spectroloom.llm.common import crc_mod, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from rows whose crc32 modulo 3 is not 1.

    Empty texts all share one score. Without labels every score is 0.5 and every document stays.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return quality.scored(docs, model).where(quality.predicted() == 1).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of SimHash near duplicates; wordless texts are one group, of equal rows one stays.

    Near duplicates are those of op5_simhash: fingerprints of 3-word shingles at most 3 of 64 bits apart,
    with no rule of similarity. Of pairs of a Jaccard similarity of 0.98 about 67 % are so near (computed for
    independent bits), of 0.95 31 %, of 0.9 9 %, of 0.8 1 %; other near copies stay.
    """
    return simhash.representatives(docs).select(COLUMNS)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that an earlier document has; what loses all its words goes."""
    done = substrings.without_repeats(docs)
    left = done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each (repeats counted); those without words are never taken."""
    return mixing.mix(docs).where(F.col("taken") > 0).select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("quality", good_quality),
    ("simhash", one_of_each),
    ("substrings", no_repeats),
    ("decontamination", no_benchmark),
    ("mixing", mixture),
]

#: The classifier and the fitting of lengths cannot be said in SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
