"""Sorted shards: exact sizes, one order over all, and nothing left of what was there."""

import gzip
import json
import random

import pyarrow.parquet as pq

from sieveline.sources import sinks


def test_shards_are_exact_and_sorted(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"d{rng.randrange(400):03d}", k) for k in range(1037)]
    df = spark.createDataFrame(rows, "doi string, n long").repartition(7)
    out = f"file://{tmp_path}/out"
    for size in (50, 100):  # the second time shards of the first are gone
        sinks.write_shards(df, out, ["doi", "n"], size)
        parts = [[json.loads(x) for x in gzip.open(p, "rt")] for p in sorted((tmp_path / "out").glob("*.gz"))]
        parts = [[(r["doi"], r["n"]) for r in p] for p in parts if p]
        assert [r for p in parts for r in p] == sorted(rows) and [len(p) for p in parts] == [size] * (1037 // size) + [1037 % size]
    sinks.write_tables(df, f"file://{tmp_path}/tables", ["doi", "n"], 250)
    sizes = [pq.read_metadata(p).num_rows for p in sorted((tmp_path / "tables").glob("*.parquet"))]
    assert sorted(x for x in sizes if x) == [37, 250, 250, 250, 250] and spark.read.parquet(f"file://{tmp_path}/tables").columns == ["doi", "n"]
    sinks.write_tables(df.limit(0), f"file://{tmp_path}/none", ["doi", "n"])
    assert spark.read.parquet(f"file://{tmp_path}/none").count() == 0
