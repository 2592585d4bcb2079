"""bootstrap_ci as registered, against a brute-force version with 1,000 draws."""

import random

from sieveline.plans import catalog


def precision(pairs):
    ranked = sorted(pairs, key=lambda p: -p[1])
    at = [i for i, p in enumerate(ranked, 1) if p[0]]
    return sum(k / i for k, i in enumerate(at, 1)) / len(at) if at else 0.0


def test_interval_of_a_thousand_draws(spark, tmp_path):
    rows = [(i, "ab"[i % 2], (i * 37) % 101, int((i * 29) % 7 > 3)) for i in range(60)]
    spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.lang: (r.lo, r.hi) for r in catalog.QUERIES["bootstrap_ci"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a", "b"]
    for lang, (lo, hi) in got.items():
        own = [(r[3], r[2] / 100.0) for r in rows if r[1] == lang]
        rng = random.Random(0)
        draws = sorted(precision([own[rng.randrange(len(own))] for _ in own]) for _ in range(1000))
        assert abs(lo - draws[25]) < 1e-12 and abs(hi - draws[974]) < 1e-12
