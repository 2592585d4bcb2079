"""The conversation trie against brute force, with ranges and bands so small that all of them meet."""

import hashlib
import random
import zlib

import pytest

from sieveline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, low long, keys string"


def brute(rows, rebuilt):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, own in convs.items():
        own.sort(key=lambda t: (*t[:3], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    own = {c: [t[2:] for t in v] for c, v in convs.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: own.get(c - c % 5, [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    nodes = {}
    for c, v in own.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, members in nodes.items():
        ended = ",".join(str(c) for c in sorted(members) if len(own[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=60, long=0):
    rng = random.Random(seed)
    rows = []
    shared = [("user", f"same beginning {k} é") for k in range(60)]
    for c in rng.sample(range(-5, 3 * n), n):
        size = rng.choice([0, 1, 2, 3, 5, 9, 12, long])
        cut = rng.randrange(size + 1)
        turns = shared[:cut] + [(rng.choice(["user", None, "assistant"]), rng.choice(["", None, "a", "b", "x" * 300])) for _ in range(size - cut)]
        rows += [(c, k if rng.random() < 0.9 else rng.choice([None, k]), r, t, 1, "q") for k, (r, t) in enumerate(turns)]
    if rows:
        rows += [rows[0], (None, 0, "user", "nobody's", 1, "q")]
        rows += [(900 + k, j, "user", f"copy {j}", 1, "q") for k in range(15) for j in range(4)]
        rows += [(950 + k, j, *shared[j % 60], 1, "q") for k in range(3) for j in range(40 + 4 * k)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,rebuilt,band,task_items,merge", [(1, True, 1024, 20_000, 64), (2, True, 4, 5, 2), (3, False, 4, 7, 3), (4, False, 3, 1000, 4), (5, True, 5, 3, 2)])
def test_trie_is_that_of_brute_force(spark, seed, rebuilt, band, task_items, merge):
    rows = made(seed, long=30)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = trie.conversation_trie(df, rebuilt, band, task_items, merge)
    got = sorted(map(tuple, got.collect()), key=str)
    want = brute(rows, rebuilt)
    assert len(got) == len(want)
    assert got == want


def test_no_conversations_give_no_nodes(spark):
    for rows in ([], [(None, 1, "user", "x", 1, "q")]):
        assert trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), True).collect() == []


def test_folds_of_ranges_are_the_fold_of_all():
    """Contracted ranges of every size, merged in turns, give the nodes of one fold over all items."""
    rng = random.Random(8)
    for case in range(60):
        words = sorted({tuple(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(rng.randrange(1, 25))})
        lcp = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        lcps = [(-1, 0)] + [(k := lcp(a, b), 10 * k) for a, b in zip(words, words[1:])]
        ids = rng.sample(range(1000), len(words))
        items = lambda: [trie.Component(len(w), 10 * len(w), 1, i, ending=i) for w, i in zip(words, ids)]
        whole, none = trie.fold(items(), lcps, "all", True)
        assert none == []

        def plain(rows):
            marks = {r["mark"]: r["parent_low"] for r in rows if r["kind"] == trie.MARK}
            keep = [{k: v for k, v in r.items() if k not in ("marks", "mark", "seq", "part")} | ({"parent_low": marks[r["mark"]]} if r.get("mark") else {}) for r in rows if r["kind"] != trie.MARK]
            return sorted(map(repr, ({k: r[k] for k in sorted(r)} for r in keep)))

        step, rows, current = rng.randrange(1, 6), [], list(zip(items(), lcps))
        turn = 0
        while True:
            turn += 1
            runs = [current[k : k + step] for k in range(0, len(current), step)]
            final = len(runs) == 1
            current = []
            for r, run in enumerate(runs):
                out, contracted = trie.fold([c for c, _ in run], [e for _, e in run], f"{turn}.{r}", final)
                rows += out
                current += [(trie.Component(*(x[k] for k in ("depth", "at", "n", "low", "kids", "leaves", "below", "ending", "marks"))), (x["lcp"], x["lcp_at"])) for x in contracted]
            if final:
                break
            step = max(step * 3, 3 * max(1, len(current) // 6))
        assert plain(rows) == plain(whole)
