"""Every corpus query with SQL gives the SQL's rows on the small tables."""

import pytest

from pointweave.llm import registry
from tests.oracle import connection, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert same(registry.queries()[name](spark, SF), connection(SF), registry.oracle_sql()[name]) == 200
