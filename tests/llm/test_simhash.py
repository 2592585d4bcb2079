import random
import re

import numpy as np
import xxhash

from sieveline.llm import simhash as S
from sieveline.llm.components import connected_components

from .fixtures import documents, frame


def brute_fp(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[find(i)] = min(ids[i], low.get(find(i), ids[i]))
    return [low.get(find(i)) for i in range(n)]


def test_near_duplicates_match_brute_force(spark):
    rows = documents()
    got = sorted(((r.doc_id is None, r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(frame(spark, rows)).collect()), key=str)
    fps = [brute_fp(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], fps)
    want = sorted(((r[0] is None, r[0], f, c) for r, f, c in zip(rows, fps, comp)), key=str)
    assert got == want
    assert len({c for c in comp}) < len(rows) - 10


def test_fingerprint_uses_the_sql_hash(spark):
    from pyspark.sql import functions as F

    x = spark.createDataFrame([("a b ñ d",)], "s string").select(F.xxhash64("s")).first()[0]
    assert x % 2**64 == xxhash.xxh64_intdigest("a b ñ d".encode(), 42)


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        x = rng.choice(sorted(fps)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randrange(1, 7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = brute_components(signed, fps)
    for n, block in ((len(fps), 8192), (len(fps), 16), (1 << 22, 64), (1 << 29, 64), (1 << 40, 64)):
        roots = {r.node: r.root for r in connected_components(S.fingerprint_links(df, n, block), task_links=block).collect()}
        assert [roots.get(s, s) for s in signed] == want, (n, block)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(300, i) for i in range(301, 330)] + [(7, 7), (5, None)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    nodes = sorted({x for e in edges if None not in e for x in e})
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges + edges[:5], "a long, b long")
    for task_links in (0, 10**6):
        got = {r.node: r.root for r in connected_components(df, task_links=task_links).collect()}
        assert {n: got.get(n, n) for n in nodes} == root


def test_every_close_pair_shares_a_key_and_passes_the_ring():
    rng = random.Random(5)
    for chain in (2, 3, 4, 5):
        masks = S.ring_masks(chain)
        for _ in range(400):
            x = 0
            for b in rng.sample(range(64), rng.randrange(5)):
                x |= 1 << b
            hit = [s for s, m in masks if not x & m]
            assert any(S.ring_passes(np.array([x], np.uint64), s)[0] for s in hit)


def test_keep_one_per_component(spark):
    rows = documents()
    df = frame(spark, rows)
    kept = S.keep_one_per_component(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    comp = brute_components([r[0] for r in rows], [brute_fp(r[1]) for r in rows])
    assert ids == sorted(set(comp))


def test_empty_table(spark):
    assert S.near_duplicates(frame(spark, [])).count() == 0
    assert S.keep_one_per_component(frame(spark, [])).count() == 0
