"""Every registered query against its SQL counterpart, in names, types and rows."""

import pytest
from compare import differences, oracle_connection

import __spark_entry__ as entry_module
from hirespan.plans import catalog


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_a_counterpart():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    found = differences(catalog.QUERIES[name](spark, sf_dir), oracle, catalog.ORACLES[name])
    assert [d for d in found if d != "no rows"] == []


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.count() > 0
    assert frame.columns[-1] == "percentile"
