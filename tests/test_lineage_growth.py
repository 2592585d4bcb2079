"""Lineage of one identifier with many rows."""

import time

from pyspark.sql import functions as F

from sieveline.operators import canonical


def test_lineage_of_many_rows_of_one_identifier(spark):
    n = 40_000
    step = F.array(F.struct(F.lit("c").alias("collector_name"), F.lit("f").alias("source_file_id"), (n - F.col("id") % (n // 2)).alias("source_line_number")))
    rows = spark.range(n).select(F.lit("d").alias("doi"), step.alias("source_lineage")).unionByName(spark.range(1).select(F.lit("e").alias("doi"), F.array().cast("array<struct<collector_name:string,source_file_id:string,source_line_number:bigint>>").alias("source_lineage")))
    began = time.perf_counter()
    got = {r.doi: r for r in canonical.lineage(rows).collect()}
    assert time.perf_counter() - began < 15
    lines = [s.source_line_number for s in got["d"]._lineage]
    assert lines == list(range(n // 2 + 1, n + 1)) and got["d"]._n == n
    assert got["e"]._lineage == [] and got["e"]._n == 1
