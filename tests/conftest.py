import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{folder}/checkpoints").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    return con


def plain(value):
    """A value as text that Spark and DuckDB agree on."""
    if value is None or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def same_rows(frame, relation) -> None:
    """Equal columns and, in any order, equal rows."""
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in frame.collect())
    have = [d[0] for d in relation.description]
    assert names == sorted(have)
    at = [have.index(n) for n in names]
    numbers = {n for n, k in frame.dtypes if k in ("double", "float")}
    want = sorted(tuple(plain(float(r[i]) if n in numbers and r[i] is not None else r[i]) for n, i in zip(names, at, strict=True)) for r in relation.fetchall())
    assert len(got) == len(want)
    assert got == want
