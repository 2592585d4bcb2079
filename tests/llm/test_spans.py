import hashlib
import random
from collections import Counter

from sieveline.llm.spans import remove_repeats

from .fixtures import documents, frame


def brute(rows, w=100):
    """Removed byte flags per row, rows in order of id."""
    first = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for k, (i, t) in enumerate(texts):
        for p in range(len(t) - w + 1):
            s = t[p : p + w]
            if s not in first or (i, p) < first[s]:
                first[s] = (i, p)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - w + 1):
            if first[t[p : p + w]] < (i, p):
                gone[p : p + w] = b"\1" * w
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows, **limits):
    df = frame(spark, rows).repartition(3)
    got = sorted(tuple(r) for r in remove_repeats(df, **limits).collect())
    assert got == brute(rows)
    return got


def test_matches_brute_force(spark):
    got = check(spark, [r for r in documents() if r[0] is not None])
    assert any(x[2] for x in got) and any(not x[2] for x in got)


def test_overlaps_periods_and_borders(spark):
    rng = random.Random(9)
    a = "".join(rng.choice("abcdé ñ\n\0z") for _ in range(400))
    b = "".join(rng.choice("abcdé ñ\n\0z") for _ in range(400))
    texts = [a, b, a[50:200] + b[:130] + a[120:260], b + a, "ab" * 200, "x" + "ab" * 120 + "y", a[:99], a[:100] if len(a[:100].encode()) >= 100 else a[:101], "q" * 100, "q" * 101, "the " * 90, "of the " + "the " * 60, a]
    rng.shuffle(texts)
    check(spark, [(i * 7 % 13, t, *[None] * 7) for i, t in enumerate(texts)])


def test_nulls_and_empty_table(spark):
    rows = [(None, "k" * 150, *[None] * 7), (None, "k" * 150, *[None] * 7), (4, None, *[None] * 7), (5, "k" * 150, *[None] * 7)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in remove_repeats(frame(spark, rows)).collect()}
    assert got[(4, 0)] == 0 and got[(5, 150)] == 150
    assert remove_repeats(frame(spark, [])).count() == 0


def test_a_line_in_every_document_and_hot_anchors(spark):
    """One line everywhere, between unlike texts: its anchors have many unlike snippets, which are split by further keys."""
    rng = random.Random(12)
    line = "this licence line stands in every document of the corpus, word for word, and is quite long, longer than a window of it; "
    rows = []
    for i in range(60):
        noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
        rows.append((i, noise(rng.randrange(90)) + line + noise(rng.randrange(60)) + line[:70] + noise(rng.randrange(1, 50)), *[None] * 7))
    plain = check(spark, rows)
    assert sum(1 for x in plain if x[2]) > 30
    for combine, hot in ((1, 3), (500_000, 6)):
        assert check(spark, rows, combine=combine, hot=hot) == plain
    check(spark, [r for r in documents() if r[0] is not None], combine=30, hot=2)


def test_rows_that_share_an_id_but_not_a_text(spark):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = text(300), text(300)
    rows = [(7, a), (7, b), (7, "x" + a), (3, b[:150]), (9, a[20:140]), (7, a), (7, None)]
    rows += [(7, text(120)) for _ in range(70)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(frame(spark, [(i, t, *[None] * 7) for i, t in rows])).collect())
    assert got[(7, 300, 0)] == 2 and got[(7, 300, 150)] == 1 and got[(7, 301, 300)] == 1 and got[(9, 120, 120)] == 1 and got[(3, 150, 0)] == 1
    assert got[(7, 0, 0)] == 1 and got[(7, 120, 0)] == 70
