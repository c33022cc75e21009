"""Every registered query of the library itself, against its SQL in DuckDB."""

import pytest
from conftest import DATA, duck, same_rows

from spectroloom import plans

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, con, name):
    same_rows(plans.queries()[name](spark, f"{DATA}/{SF}"), con.execute(plans.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql(spark, name):
    assert plans.queries()[name](spark, f"{DATA}/{SF}").count() > 0


def test_flagship(spark):
    assert plans.flagship(spark, f"{DATA}/{SF}").count() > 0
