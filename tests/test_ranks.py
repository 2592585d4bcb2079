"""Ranks by ranges against plain sorting, with a large group, one score for all, and few rows a task; draws against random.Random."""

import random

from pyspark.sql import functions as F

from sieveline.operators import metrics, ranks


def ap(pairs):
    at = [k for k, (y, _) in enumerate(sorted(pairs, key=lambda p: -p[1]), 1) if y]
    return sum(i / k for i, k in enumerate(at, 1)) / len(at) if at else 0.0


def scored(spark, n=4000, ties=False):
    rng = random.Random(5)
    rows = [(k, rng.choice("aaab") if k % 9 else "c", int(rng.random() < 0.3), 0.5 if ties else rng.random()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "ord long, g string, label int, score double").repartition(5)


def test_average_precision_of_many_scores_and_of_one(spark):
    for ties in (False, True):
        rows, df = scored(spark, ties=ties)
        got = {r.g: r.ap for r in metrics.average_precision(df, ["g"]).collect()}
        for g in "abc":
            assert abs(got[g] - ap([(y, s) for _, h, y, s in rows if h == g])) < 1e-9
        assert abs(metrics.average_precision(df, []).first().ap - ap([(y, s) for _, _, y, s in rows])) < 1e-9
    none = spark.createDataFrame([], "ord long, g string, label int, score double")
    assert metrics.average_precision(none, ["g"]).collect() == [] and metrics.average_precision(none, []).first().ap == 0


def test_no_range_holds_a_large_group(spark):
    """200,000 rows of one group and one score: the windows' partitions stay near an even share."""
    df = spark.range(200_000).select(F.col("id").alias("ord"), F.lit("g").alias("g"), F.lit(0.5).alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = []
        cut = ranks.cut
        ranks.cut = lambda d: held.append(cut(d)) or held[-1]
        out = ranks.ranked(df, ["g"], [F.desc("score"), F.asc("ord")], "label")
        wrong = out.where((F.col("rank") != F.col("ord") + 1) | (F.col("hits") != F.floor((F.col("ord") + 1) / 2))).count()
    finally:
        ranks.cut = cut
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in held[0].groupBy("_range").count().collect()]
    assert wrong == 0 and len(sizes) == 16 and max(sizes) < 3 * 200_000 / 16


def test_shares_at_the_top(spark):
    rows, df = scored(spark, 700)
    got = {(r.g, r.percent): (r.k, r.precision, r.recall) for r in metrics.at_k(df, ["g"], [0.5, 1, 10]).collect()}
    for g in "abc":
        own = sorted(((y, s) for _, h, y, s in rows if h == g), key=lambda p: -p[1])
        for p in (0.5, 1.0, 10.0):
            k = max(1, round(len(own) * p / 100))
            top = sum(y for y, _ in own[:k])
            assert got[g, p] == (k, top / k, top / sum(y for y, _ in own))


def test_draws_are_those_of_the_stream(spark):
    got = {(r.size, r.draw, r.pos): r.at for r in metrics.drawn(spark.createDataFrame([(1,), (7,), (64,), (1000,)], "size long"), 7, step=3).collect()}
    for n in (1, 7, 64, 1000):
        rng = random.Random(0)
        assert [got[n, d, k] for d in range(7) for k in range(n)] == [rng.randrange(n) for _ in range(7 * n)]
    assert len(got) == 7 * 1072


def test_interval_is_that_of_lists(spark):
    rows, df = scored(spark, 90, ties=True)
    got = {r.g: (r.lo, r.hi) for r in metrics.bootstrap_ci(df, ["g"], 40).collect()}
    for g in "abc":
        own = [(y, s) for _, h, y, s in rows if h == g]
        rng = random.Random(0)
        values = sorted(metrics.average_precision_list(*zip(*[own[rng.randrange(len(own))] for _ in own])) for _ in range(40))
        assert abs(got[g][0] - values[1]) < 1e-9 and abs(got[g][1] - values[38]) < 1e-9
