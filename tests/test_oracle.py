"""Every registered query against its DuckDB equivalent on the small tables."""

import pytest
from oracle_compare import compare, connect

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 170


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    message = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert message is None, message
