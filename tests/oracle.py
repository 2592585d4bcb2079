"""Runs a registered query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in (t for t in TABLES if os.path.exists(f"{sf_dir}/{t}.parquet")):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return v
    return str(v)


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck(sf_dir).sql(sql)
    assert sorted(rel.columns) == names, (name, sorted(rel.columns), names)
    at = [rel.columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got != want:
        more, less = list((got - want).items())[:3], list((want - got).items())[:3]
        raise AssertionError(f"{name}: {sum(got.values())} and {sum(want.values())} rows\n{names}\nonly here {more}\nonly in SQL {less}")
    kinds = {c: (dict(df.dtypes)[c], str(rel.types[rel.columns.index(c)])) for c in names}
    return sum(got.values()), kinds


SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
