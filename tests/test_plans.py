"""What the optimizer makes of the operators."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from spectroloom import plans
from spectroloom.operators import filters, joins, windows
from spectroloom.sources import spectra

SF = f"{DATA}/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q for q in plans.queries() if not q.startswith("stream_")))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan_of(plans.queries()[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    df = filters.in_range(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_extendedprice", 30000, 30500).select("l_orderkey")
    plan = plan_of(df)
    assert "GreaterThanOrEqual(l_extendedprice,30000.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


def test_band_joins_are_equi_joins(spark):
    a = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_acctbal")
    b = spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey", "s_acctbal")
    plan = plan_of(joins.band_join(a, b, "c_acctbal", "s_acctbal", 5.0))
    assert "NestedLoop" not in plan and ("HashJoin" in plan or "SortMergeJoin" in plan)


def test_global_rates_use_no_single_partition_of_rows(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "P").alias("decoy"))
    plan = plan_of(windows.running_fdr(df, "o_totalprice", "decoy", [F.col("o_orderkey")]))
    # the only single partition holds a row for each part
    for line in plan.splitlines():
        assert "SinglePartition" not in line or "o_orderkey" not in line


def test_scan_limits_reach_the_run(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("int").alias("scan_num"), F.lit(1).alias("ms_level"), F.array(F.lit(1.0)).alias("mz"), F.array(F.lit(2.0)).alias("intensity"))
    spectra.write_run(rows, str(tmp_path / "run"))
    plan = plan_of(spectra.read_run(spark, str(tmp_path / "run"), 5, 9).select("scan_num"))
    assert "GreaterThanOrEqual(scan_num,5)" in plan and "mz" not in plan.split("ReadSchema")[1]
