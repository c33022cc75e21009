"""What the operators of this subpackage share: tables, the shared scratch folder and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: ASCII white space: the separators of words in most contracts here.
WHITE = "\\x20\\x09-\\x0D"
WORD = f"[^{WHITE}]+"
#: Bytes of texts that a Python worker takes at a time, about (one text at least).
SLICE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where a session has no such setting (tests, a single machine), one below the
    driver's temp folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spectroloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/loom-{uuid.uuid4().hex}"


def written(df: DataFrame, level: int = 3, page: int = 1 << 20) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage. ``level`` is zstandard's, ``page``
    the bytes of a page, which is compressed as one."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", page).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._loom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what ``written`` stored, once nothing reads it any more."""
    path = getattr(df, "_loom_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def wider(df: DataFrame, **kinds: str | DataType) -> StructType:
    """The schema of ``df`` with more columns (a schema's own ``add`` would change the frame's)."""
    out = StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, with as many underscores behind each as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(column: str, m: int):
    """crc32 of the decimal text of an integer column, modulo ``m`` (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % m


def ascii_lower(column):
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fanout(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: what hash partitions of our own follow."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, at: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` bytes of a text column: long values are never held many at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


_IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def spaced(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text with one space between, and where each begins and ends; no object is made for each word."""
    data = np.frombuffer(text, np.uint8)
    white = _IS_WHITE[data]
    # of the white space behind a word the first byte stays
    keep = ~white
    keep[1:] |= ~white[:-1]
    data, white = data[keep], white[keep]
    data = np.where(white, np.uint8(32), data)
    if len(data) and white[-1]:
        data, white = data[:-1], white[:-1]
    if not len(data):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(white)
    return data.tobytes(), np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])


def encoded(cut: list[tuple[bytes, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of several texts, as ``spaced`` cuts them, as numbers; the bounds of the texts; the words (a space behind) by number."""
    cut = [(joined + b" ", starts) if len(starts) else (b"", starts) for joined, starts, _ in cut]
    begin = np.concatenate([[0], np.cumsum([len(joined) for joined, _ in cut])]).astype(np.int64)
    offsets = np.concatenate([*(starts + b for (_, starts), b in zip(cut, begin.tolist(), strict=False)), begin[-1:]]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(joined for joined, _ in cut))]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum([len(s) for _, s in cut])]).astype(np.int64), found.dictionary


def joined_unevenly(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right``, in which ``key`` (of no nulls) is unique; an inner join on it.

    Keys of more than a thousandth of the rows of ``left``, of which there are fewer than a thousand, go by
    broadcast, so that no task gets all the rows of one; others by hash. ``left`` is read up to four times.
    """
    hot = left.groupBy(key).count().where(f"count > {max(1000, left.count() // 1000)}").select(key)
    if not hot.limit(1).count():
        return left.join(right, key)
    few = F.broadcast(hot)
    loud = left.join(F.broadcast(right.join(few, key, "left_semi")), key)
    return loud.unionByName(left.join(few, key, "left_anti").join(right, key))
