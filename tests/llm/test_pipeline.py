"""The whole pipeline against a brute-force version of its five stages, on awkward rows."""

import random

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import decontaminate, mixing
from sieveline.llm.common import in_training_fold
from sieveline.llm.queries import tokenizer_path

from .fixtures import SCHEMA, documents, frame
from .test_models import edit_distance_in
from .test_simhash import brute_components, brute_fp
from .test_tables import WORD, brute_statistics

LABELS = "doc_id long, quality int, toxic int, text string"
BENCHMARK = "item_id long, text string, doc_id long"


def passes_base(text):
    n, _, _, _, repeated = brute_statistics(text)
    return n >= 10 and 100 * repeated <= 20 * n


def one_of_each(rows):
    """One row of the smallest id of each near-duplicate component, that of the least hash among different texts of the id."""
    comp = brute_components([r[0] for r in rows], [brute_fp(r[1]) for r in rows])
    # components of null ids alone are one for each set of rows that reach each other
    out, seen = [], set()
    for r, c in zip(rows, comp):
        if r[0] == c and c is not None and c not in seen:
            seen.add(c)
            out.append(r)
    return out


def mixed(spark, rows, seed=mixing.SEED, block=mixing.BLOCK_WORDS, shards=mixing.SHARDS):
    """(doc_id, text) of each row of the mix, run by run."""
    df = frame(spark, rows).select("doc_id", "text", "source", F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).alias("h"))
    by = {}
    for r in df.collect():
        by.setdefault(r.source, []).append((r.h, r.doc_id, WORD.findall(r.text or ""), r.text))
    plan = {p["source"]: p for p in mixing.plan_mix([(s, sum(len(x[2]) for x in v)) for s, v in by.items()], block, shards)}
    out = []
    for source, v in by.items():
        v.sort(key=lambda x: ((x[0] % 2**64 >> 20) % mixing.MIN_PIECES, x[0], x[1] is not None, x[1] or 0, len(x[2])))
        parts, at = mixing._shard_rows(plan[source], block, shards, seed), 0
        for _, doc_id, words, text in v:
            lo, hi = at, at + len(words)
            at = hi

            def take(a, b, doc_id=doc_id, words=words, text=text, lo=lo):
                if a < b:
                    out.append((doc_id, text if b - a == len(words) else " ".join(words[a - lo : b - lo])))

            for p_lo, p_hi, rounds, rest, first in parts:
                a, b = max(lo, p_lo), min(hi, p_hi)
                for _ in range(rounds):
                    take(a, b)
                take(max(a, first), min(b, first + rest))
                take(max(a, first - (p_hi - p_lo)), min(b, first + rest - (p_hi - p_lo)))
    return out


def brute(spark, rows, items):
    from tokenizers import Tokenizer

    rows = one_of_each([r for r in rows if passes_base(r[1])])
    words = decontaminate.words_of

    def clean(text):
        found = words(text)
        return not any((w := words(t)) and found and (d := edit_distance_in(w, found)) <= decontaminate.budget(len(w)) and d < len(w) for _, t, _ in items)

    taken = mixed(spark, [r for r in rows if clean(r[1])])
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out, at = [], 0
    for doc_id, text in sorted(taken, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def save(spark, folder, rows, labels, items):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(21)
    rows = documents(n=70)
    item = " ".join(f"secret{rng.randrange(50)}" for _ in range(12))
    more = [f"t{rng.randrange(3000)}" for _ in range(400)]
    edited = item.split()
    edited[3] = "changed"
    rows += [(300, " ".join(more[:40] + item.split() + more[40:80]), "en", "b", 1, None, None, None, None), (301, " ".join(more[80:200] + edited), None, "a", 1, None, None, None, None)]
    rows += [(302 + k, " ".join(f"u{rng.randrange(9000)}" for _ in range(rng.randrange(12, 900))), "en", ["a", "b", None][k % 3], None, None, None, None, None) for k in range(25)]
    items = [(1, item, 5), (2, None, None), (3, "", 7)]
    labels = [(i, 1, 0, "x") for i in range(0, 90)] + [(None, 0, 0, None), (4, None, None, None)]
    save(spark, str(tmp_path), rows, labels, items)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    want = brute(spark, rows, items)
    assert got == want and len(got) > 30
    assert not {300, 301} & {r[0] for r in got}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    save(spark, str(tmp_path), [], [(1, 1, 0, None)], [(1, "some item of the benchmark", None)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_hand_on_the_columns_of_documents(spark, tmp_path):
    rows = documents()
    save(spark, str(tmp_path), rows, [(1, 1, 0, None)], [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", None)])
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in frame(spark, []).schema], name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontaminate", "mix_sources", "token_ids"] and SCHEMA


def test_learned_rules_are_those_of_plain_sequential_covering(spark):
    """The learner, rule by rule, against a plain version over lists of ratios."""
    import math

    from sieveline.llm import rules

    rng = random.Random(31)
    rows, labels = [], []
    for i in range(500):
        bad = i % 3 == 0
        text = " ".join((f"W{rng.randrange(900)}%%%" if bad and rng.random() < 0.7 else f"w{rng.randrange(900)}") for _ in range(rng.randrange(20, 60)))
        rows.append((i, text + (" 12345" * 9 if i % 7 == 0 else ""), *[None] * 7))
        labels.append((i, int(not (bad or i % 7 == 0)), 0, None))
    stats = rules.with_statistics(frame(spark, rows))
    y = spark.createDataFrame(labels, LABELS)
    found = rules.learn_from(stats, y)
    own = stats.where(in_training_fold(F.col("doc_id")) & ~rules.base_failed()).select("doc_id", *[rules.ratio(n).alias(n) for n in rules.RATIOS]).collect()
    bad = {i: 1 - q for i, q, *_ in labels}
    data = [(bad[r.doc_id], zlib.crc32(str(r.doc_id).encode()) % 9 < 6, {n: r[n] for n in rules.RATIOS}) for r in own]
    thresholds = {n: sorted({c.threshold for rule in found for c in rule if c.feature == n}) for n in rules.RATIOS}
    assert found
    left = data
    for rule in found:
        holds = lambda x, cs: all(x[2][c.feature] is not None and ((x[2][c.feature] >= c.threshold) == c.above) for c in cs)
        grow = [x for x in left if x[1]]
        for k, c in enumerate(rule):
            before = [x for x in grow if holds(x, rule[:k])]
            p0, n0 = sum(x[0] for x in before), sum(1 - x[0] for x in before)

            def gain(cond, before=before, p0=p0, n0=n0):
                hit = [x for x in before if holds(x, [cond])]
                p, n = sum(x[0] for x in hit), sum(1 - x[0] for x in hit)
                return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0

            # no condition on a threshold that the learner found useful gains more than the one it took
            assert gain(c) > 0
            for n, ts in thresholds.items():
                assert all(gain(rules.Condition(n, above, t)) <= gain(c) + 1e-9 for t in ts for above in (True, False))
        held = [x for x in left if not x[1] and holds(x, rule)]
        p, n = sum(x[0] for x in held), sum(1 - x[0] for x in held)
        assert p / (p + n + 1) >= 0.9
        left = [x for x in left if not holds(x, rule)]
    assert Counter(x[0] for x in left)[1] < 0.35 * Counter(x[0] for x in data)[1]
