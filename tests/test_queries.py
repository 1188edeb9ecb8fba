import pytest

import __spark_entry__ as entry
from sableflow.plans import registry
from tests.twin import compare

# family plans are large; their operators are compared one by one
SLOW = {"family_macd", "family_ewm_z_score", "family_multi_horizon", "family_ratio_spread", "family_macro_momentum"}
ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", [n for n in ORACLE if n not in SLOW])
def test_query_equals_its_sql(spark, sf, name):
    compare(spark, sf, registry.queries()[name], ORACLE[name])


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in ORACLE])
def test_query_without_sql_gives_rows(spark, sf, name):
    rows = registry.queries()[name](spark, sf)
    assert rows.columns and rows.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
