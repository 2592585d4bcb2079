"""Author history and the tagger against brute force and cases."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sieveline.operators import canonical, models


@pytest.mark.parametrize("rare,listed", [(64, 16), (0, 16), (0, 0), (3, 16), (3, 0)])
@pytest.mark.parametrize("seed", [1, 2])
def test_author_history_matches_brute_force(spark, monkeypatch, seed, rare, listed):
    monkeypatch.setattr(canonical, "LISTED_PER_PAIR", listed)
    rng = random.Random(seed)
    rows, notices = [], []
    for i in range(160):
        names = [f"A{rng.randrange(9)}" for _ in range(rng.randrange(0, 5))] + ["Everyone"] * (seed == 2) + ["Everyone"] * (i % 3 == 0)
        rows.append((str(i), date(2000, 1, 1) + timedelta(days=rng.randrange(90)), names))
        for _ in range(rng.randrange(3) if i % 2 else 0):
            notices.append((str(i), date(2000, 1, 1) + timedelta(days=rng.randrange(120))))
    notices.append(("nobody", date(2000, 1, 1)))
    a = spark.createDataFrame(rows, "doi string, publication_date date, authors array<string>")
    n = spark.createDataFrame(notices, "doi string, notice_date date")
    active = {d: max(p, min(x for k, x in notices if k == d)) for d, p, _ in rows if any(k == d for k, _ in notices)}
    by = {d: set(names) for d, _, names in rows}
    want = {d: sum(1 for o, t in active.items() if t < p and by[o] & by[d]) for d, p, _ in rows}
    got = {r.doi: r.author_history_signal_count for r in canonical.author_history(a, n, rare).collect()}
    assert got == want and max(want.values()) > 10


@pytest.mark.parametrize("rare", [64, 5])
def test_long_author_lists_are_not_paired(spark, rare):
    """2,000 authors on 50 articles, a third of them flagged: 300 million pairs, of which none is made."""
    rng = random.Random(4)
    everyone = [f"A{k}" for k in range(2000)]
    rows = [(str(i), date(2000, 1, 1) + timedelta(days=rng.randrange(90)), rng.sample(everyone, 2000 - 7 * i)) for i in range(50)]
    rows += [(f"s{i}", date(2000, 2, 1) + timedelta(days=i), [rng.choice(everyone), f"B{i}"]) for i in range(30)]
    notices = [(str(i), date(2000, 1, 1) + timedelta(days=rng.randrange(90))) for i in range(0, 50, 3)]
    a = spark.createDataFrame(rows, "doi string, publication_date date, authors array<string>")
    n = spark.createDataFrame(notices, "doi string, notice_date date")
    active = {d: max(p, dict(notices)[d]) for d, p, _ in rows if d in dict(notices)}
    by = {d: set(names) for d, _, names in rows}
    want = {d: sum(1 for o, t in active.items() if t < p and by[o] & by[d]) for d, p, _ in rows}
    out = canonical.author_history(a, n, rare)
    assert {r.doi: r.author_history_signal_count for r in out.collect()} == want and max(want.values()) > 10


def test_author_history_of_empty_tables(spark):
    a = spark.createDataFrame([("1", date(2000, 1, 1), ["A"])], "doi string, publication_date date, authors array<string>")
    n = spark.createDataFrame([], "doi string, notice_date date")
    assert [tuple(r) for r in canonical.author_history(a, n).collect()] == [("1", 0)]
    assert canonical.author_history(a.limit(0), n).count() == 0


CASES = [
    ("Journal official_notice retraction", ["retraction"]),
    ("a retracted paper", []),
    ("Expression of Concern", ["expression_of_concern"]),
    ("expression_of_concern", ["expression_of_concern"]),
    ("correction", []),
    ("a Major Correction", ["major_correction"]),
    ("major_correction", ["major_correction"]),
    ("PubPeer", []),
    ("the community says", ["community_flag"]),
    ("a figure", ["image_issue"]),
    ("duplication of an IMAGE", ["image_issue"]),
    ("paper_mill_signal", []),
    ("paper mill", ["paper_mill_signal"]),
    ("Template Family", ["paper_mill_signal"]),
    ("tortured", []),
    ("tortured phrase", ["tortured_phrase"]),
    ("revision timing", ["metadata_anomaly"]),
    ("authorship", ["metadata_anomaly"]),
    (None, []),
]


def test_tagger_cases(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, t string")
    got = {r.k: r.tags for r in df.select("k", models.predicted_tags(F.col("t")).alias("tags")).collect()}
    assert got == {k: tags for k, (_, tags) in enumerate(CASES)}


def test_entries_are_read_one_by_one(spark):
    entry = "struct<source_name: string, observed_label: string, summary: string>"
    df = spark.createDataFrame([([("paper", "x", "y tortured"), ("phrase", "mill", "")],)], f"provenance array<{entry}>")
    assert df.select(models.predicted_tags(models.evidence_text()).alias("t")).first().t == []
