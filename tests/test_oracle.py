"""Every query with a SQL twin gives its twin's rows; every other one runs."""

import pytest
from compare import both, exists

from seqlens.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.skipif(not exists(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    (columns, got), (names, want) = both(spark, QUERIES[name], SQL[name], SF)
    assert columns == names
    assert got == want
    assert got


@pytest.mark.skipif(not exists(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    assert df.count() > 0
