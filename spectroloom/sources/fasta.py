"""Protein databases: FASTA in and out, decoys, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectroloom.functions import text
from spectroloom.operators.scratch import materialised

#: Fixed value: what the names of decoy proteins begin with.
DECOY_PREFIX = "XXX_"
EXTENSIONS = (".fasta", ".fa", ".faa")


def valid_extension(path: str) -> bool:
    return path.lower().removesuffix(".gz").endswith(EXTENSIONS)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, sequence), one row a protein; files are split at records and read in parallel.

    Records without a name are left out; a record without residues has an empty sequence.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("r"))
    head = F.regexp_extract("r", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    rows = records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\S+\s+(.*)$", 1)).alias("description"), body.alias("sequence"))
    return rows.where(F.col("name") != "")


def write_fasta(proteins: DataFrame, path: str, width: int = 60) -> None:
    """A record a row; sequences are cut into lines of ``width``."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    head = F.concat(F.lit(">"), F.concat_ws(" ", "name", F.nullif("description", F.lit(""))))
    proteins.select(F.concat_ws("\n", head, lines).alias("value")).write.text(path)


def with_decoys(proteins: DataFrame, how: str = "reverse", keep_last: str = "", seed: int = 7) -> DataFrame:
    """Targets and their decoys: reversed (between cuts of an enzyme with ``keep_last``) or shuffled by a seeded hash."""
    if how not in ("reverse", "shuffle"):
        raise ValueError("how is reverse or shuffle")
    turned = text.decoy_reverse(F.col("sequence"), keep_last) if how == "reverse" else text.decoy_shuffle(F.col("sequence"), F.lit(seed))
    decoys = proteins.withColumn("sequence", turned).withColumn("name", F.concat(F.lit(DECOY_PREFIX), "name"))
    return proteins.withColumn("is_decoy", F.lit(False)).unionByName(decoys.withColumn("is_decoy", F.lit(True)))


def with_offsets(proteins: DataFrame, order: str = "name") -> DataFrame:
    """``proteins`` with ``start_offset``: where each sequence begins if all are joined by a delimiter.

    Sums run within ranges of the order, written once, whatever the names begin with; only a row for each range goes
    through one window.
    """
    ranges = int(proteins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialised(proteins.repartitionByRange(ranges, order).withColumn("_part", F.spark_partition_id()))
    size = F.length("sequence") + 1
    totals = parts.groupBy("_part").agg(F.sum(size).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return out.join(starts, F.col("_part").eqNullSafe(F.col("_p"))).withColumn("start_offset", (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_p", "_before", "_within")
