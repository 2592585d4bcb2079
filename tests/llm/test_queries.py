import pytest
from oracle import SF, compare

from sieveline.llm import queries

from .fixtures import documents, frame


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("name", ["op4_simhash", "op5_suffix_dedup", "op10_mix", "op11_jaccard"])
def test_sql_of_awkward_rows(spark, tmp_path, name, seed):
    rows = list({r[0]: r for r in documents(seed, 90) if r[0] is not None}.values())
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], str(tmp_path))


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
