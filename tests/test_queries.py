"""Every query with SQL gives the same rows as DuckDB; the others run and give rows."""

import pytest
from compare import same

from mosaikon import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLE[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
