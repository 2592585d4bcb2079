"""Inverted abstracts go by row: one shuffle of texts, none of words, and rows that share an id stay apart."""

from pyspark.sql import functions as F

from sieveline.functions import scalars as S
from sieveline.plans import catalog


def test_words_are_not_shuffled_and_rows_of_one_id_stay_apart(spark, tmp_path):
    rows = [(1, "b a b"), (1, "c a"), (2, None), (None, "x  y\tx")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.QUERIES["inverted_abstract"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "b a b"), (1, "c a"), (2, ""), (None, "x y x")], key=str)


def test_inversion_and_restoring(spark):
    words = spark.createDataFrame([(["b", "a", "b", None, "c"],), ([],), (None,), ([""],)], "w array<string>")
    assert [r.m for r in words.select(S.invert_words(F.col("w")).alias("m")).collect()] == [{"a": [1], "b": [0, 2], "c": [4]}, {}, None, {"": [0]}]
    maps = spark.sql("select * from values (map('a', array(0, 2), 'b', array(1, 2, null), 'c', array(5))), (null), (map()), (map('a', null, 'b', array(1))), (map('z', array(3, 3), 'y', array(1))) t(m)")
    assert [r.x for r in maps.select(S.restore_abstract(F.col("m")).alias("x")).collect()] == ["a b b c", "", "", "", "y z"]
