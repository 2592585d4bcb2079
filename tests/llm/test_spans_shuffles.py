"""Shuffles of the repeated-span search: texts go through one, however many rounds split hot anchors."""

import random

from sieveline.llm.spans import remove_repeats

from .fixtures import frame


def shuffled_bytes(spark) -> dict[int, int]:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_texts_are_shuffled_once_with_hot_anchors(spark, tmp_path):
    rng = random.Random(14)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    line = noise(130)
    # few documents with unlike snippets of the line's anchors, and many long texts that no split has to see
    rows = [(i, noise(rng.randrange(90)) + line + noise(50), *[None] * 7) for i in range(40)]
    rows += [(i, noise(30_000), *[None] * 7) for i in range(40, 140)]
    size = sum(len(r[1]) for r in rows)
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    before = set(shuffled_bytes(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where neither side of a join is small
    try:
        got = remove_repeats(spark.read.parquet(str(tmp_path / "docs")), hot=6).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r.n_removed >= 130 for r in got) == 39
    wide = [n for stage, n in shuffled_bytes(spark).items() if stage not in before and n > 0.5 * size]
    # anchors with their places, and texts
    assert len(wide) == 2
