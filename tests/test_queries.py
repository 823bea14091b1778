"""Every query against DuckDB on the small tables."""

import pytest

from plumbline.queries import ORACLES, QUERIES

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck.sql(ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
