import pytest

from sieveline.plans import catalog

from oracle import SF, compare

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    rows, kinds = compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)
    for column, (ours, theirs) in kinds.items():
        assert KINDS.get(ours) == theirs or ours.startswith("decimal"), (name, column, ours, theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
