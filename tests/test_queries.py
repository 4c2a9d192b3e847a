"""Every registered query against its SQL, and the driver contract."""

import __spark_entry__ as driver
import pytest
from checks.compare import differences, duck
from checks.oracle import ORACLE
from checks.queries import QUERIES
from helpers import SMALL


#: Queries whose result is empty at the smallest scale.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    found = differences(spark, con, QUERIES[name], ORACLE[name], SMALL)
    assert found == (["no rows"] if name in MAY_BE_EMPTY else [])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    assert df.count() == 1500
