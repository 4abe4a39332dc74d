"""Every query with SQL gives the SQL's rows on the small scene."""

import pytest

from pointweave.plans.queries import QUERIES, SQL
from tests.oracle import connection, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert same(QUERIES[name](spark, SF), con, SQL[name]) > 0


@pytest.mark.parametrize("name", ["vw_reduce", "outlines_traced", "outlines_world", "align_peak"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
