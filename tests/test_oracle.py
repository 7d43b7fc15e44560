"""Every registered query with SQL gives the same rows as the SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
# the newest hour of the smallest tables has no closed minute with posts
LARGER = {"trend_5min": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    sf = LARGER.get(name, SF)
    result = compare(spark, connect(sf), name, sf)
    assert result.startswith("ok") and not result.startswith("ok 0"), result


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only(spark, name):
    assert not queries()[name](spark, SF).isEmpty()


def test_entry(spark):
    assert not entry(spark).isEmpty()
