"""Every SQL-expressible registered query equals its DuckDB twin (sf0.001)."""

import pytest

from postlens.plans.catalog import REGISTRY
from data_paths import SF_SMALL

ORACLE = sorted(n for n, q in REGISTRY.items() if q.sql is not None)


@pytest.mark.parametrize("name", ORACLE)
def test_matches_duckdb(spark, duck_small, name):
    from oracle_check import check

    ok, msg = check(spark, duck_small, REGISTRY[name], SF_SMALL)
    assert ok, msg


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert df.columns[0] == "date"
