"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import compare
import pytest

from sheaf.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    difference = compare.compare(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert difference is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
