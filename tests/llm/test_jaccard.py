"""The Jaccard join against all pairs, with blocks so small that groups are split; the trees against all pairs of sets."""

import random
import re

import numpy as np
import pytest

from sieveline.llm import jaccard, sigtree

from .fixtures import documents, frame


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], len(s), low.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def near_copies(seed, base=3, copies=40, size=60):
    """Copies with runs of edits of all rates, short texts, ties at exactly 80 of 100, and passages that many share."""
    rng = random.Random(seed)
    rows = []
    passage = [f"p{k}" for k in range(30)]
    for b in range(base):
        text = [f"b{b}x{k}" for k in range(size + 7 * b)]
        for _ in range(copies):
            w = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [f"e{rng.randrange(50)}"] * rng.randrange(2)
            rows.append(" ".join(w))
    for _ in range(40):
        w = [f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))]
        at = rng.randrange(len(w))
        rows.append(" ".join(w[:at] + passage + w[at:]))
    exact = [f"t{k}" for k in range(13)]  # nine shingles; one at its end leaves 9 of 10, two leave 9 of 11, three 9 of 12
    rows += [" ".join(exact + [f"u{k}" for k in range(n)]) for n in range(5)]
    rows += ["A b", "a B", "a b c", "a b c d", "a b c d e", "Ａ b"]
    rng.shuffle(rows)
    return [(k, t, "en", "a", 1, "x", "y", "z", "q") for k, t in enumerate(rows, 1000)]


@pytest.mark.parametrize("seed,sent,elements,size", [(1, 200_000, 2_000_000, 1 << 25), (2, 0, 400, 4000), (3, 200_000, 3000, 1 << 14)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, sent, elements, size):
    monkeypatch.setattr(jaccard, "SENT_SETS", sent)
    rows = documents(seed, 60) + near_copies(seed)
    got = jaccard.jaccard_components(frame(spark, rows).repartition(3), block_elements=elements, block_bytes=size).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_no_documents_give_no_rows(spark):
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []
    rows = [(1, None, "en", "a", 1, "x", "y", "z", "q"), (None, " ", "en", "a", 1, "x", "y", "z", "q")]
    assert sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows)).collect()), key=str) == [(1, 0, 1), (None, 0, None)]


def random_sets(rng, n):
    base = [rng.choice(10**6, s, replace=False).astype(np.uint64) for s in (5, 30, 31, 200, 900)]
    out = []
    for _ in range(n):
        s = base[rng.integers(len(base))].copy()
        k = int(len(s) * rng.choice([0, 0.05, 0.1, 0.2, 0.5]))
        s[:k] = rng.choice(10**6, k, replace=False) + 10**6
        out.append(np.unique(s * np.uint64(0x9E3779B97F4A7C15)))
    return out


def components(n, links, start):
    root = {k: k for k in range(n)}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in links + [(k, start.index(c)) for k, c in enumerate(start)]:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("n", [2, 5, 40, 150])
def test_trees_lose_no_link(n):
    rng = np.random.default_rng(n)
    for _ in range(6):
        sets = random_sets(rng, n)
        start = [int(c) for c in rng.choice([3, *range(100, 100 + n)], n)]
        pairs = [(i, j) for i in range(n) for j in range(i) if (o := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - o)]
        got = sigtree.linked(sets, np.array(start))
        assert all((i, j) in pairs or (j, i) in pairs for i, j in got)
        assert components(n, got, start) == components(n, pairs, start)
        bits = [sigtree.bitmap(s, sigtree.bits_for(len(s))) for s in sets]
        size = np.array([len(s) for s in sets])
        spare = size - np.array([int(np.bitwise_count(b).sum()) for b in bits])
        met = {tuple(sorted(p)) for i, j in sigtree.near_pairs(size, size, spare, bits, np.arange(n), np.lexsort((size,))) for p in zip(i.tolist(), j.tolist())}
        assert met >= {tuple(sorted(p)) for p in pairs} and len(met) < n * (n - 1) / 2 or n < 10


def test_linked_sets_share_a_key_and_enough_early_elements(spark):
    rng = np.random.default_rng(0)
    least = [r[0] for r in spark.range(400).select(jaccard._least_shared(jaccard.F.col("id"))).collect()]
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        a = np.sort(rng.choice(10**9, n, replace=False).astype(np.uint64))
        k = int(rng.integers(0, n // 4 + 1))
        b = a.copy() if rng.random() < 0.5 else a[: n - k]
        b = np.unique(np.concatenate((b, rng.choice(10**3, int(rng.integers(0, n // 4 + 1)), replace=False).astype(np.uint64))))
        o = len(np.intersect1d(a, b))
        if 100 * o >= 80 * (len(a) + len(b) - o):
            assert len(np.intersect1d(*(s[: jaccard.n_keys(len(s))] for s in (a, b))))
            both = len(np.intersect1d(*(s[: jaccard.n_early(len(s))] for s in (a, b))))
            assert both >= max(least[len(a)], least[len(b)])
