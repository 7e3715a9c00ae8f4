import pytest

import __spark_entry__ as entry
from castgraph.plans import registry
from tests.oracle import same_rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    same_rows(spark, registry.queries()[name], registry.oracle_sql()[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_named_columns_and_rows(spark, data, name):
    df = registry.queries()[name](spark, data)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns) and len({str(r) for r in rows}) == len(rows)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
