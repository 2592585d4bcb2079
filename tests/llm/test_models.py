"""Decontamination against brute force; the two classifiers on held-out rows of made-up text."""

import random
import zlib

from sieveline.llm import compression, decontaminate, toxicity

from .fixtures import frame


def edit_distance_in(item, text):
    """Least word edits of item against any run of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_benchmark_matches_are_those_of_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(12)]
    items += [(50, ""), (51, None), (52, "Lone"), (None, "nobody's item here at all")]
    rows = []
    for i in range(70):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        if i % 2:
            item = rng.choice(items[:12])[1].split()
            for _ in range(rng.randrange(0, 10)):
                k = rng.randrange(len(item) + 1)
                op = rng.randrange(3)
                if op == 0:
                    item.insert(k, rng.choice(vocabulary))
                elif item and k < len(item):
                    item[k : k + 1] = [] if op == 1 else [rng.choice(vocabulary)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        rows.append((i, "  ".join(x.upper() + "," for x in w), *[None] * 7))
    rows += [(200, None, *[None] * 7), (201, "", *[None] * 7), (None, items[0][1], *[None] * 7), (203, "a lone one", *[None] * 7)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 600):
        got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.benchmark_matches(frame(spark, rows), benchmark, block_bytes=block).collect()}
        want = {}
        for d in rows:
            for i, t in items:
                a, b = decontaminate.words_of(t), decontaminate.words_of(d[1])
                if a and b and (x := edit_distance_in(a, b)) <= decontaminate.budget(len(a)) and x < len(a):
                    want[(d[0], i)] = x
        assert got == want
    assert len(want) > 20
    for block in (decontaminate.BLOCK_BYTES, 600):
        kept = decontaminate.drop_contaminated(frame(spark, rows), benchmark, block_bytes=block)
        assert kept.columns == frame(spark, rows).columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in rows if d[0] not in {k for k, _ in want})
        assert decontaminate.drop_contaminated(frame(spark, []), benchmark, block_bytes=block).count() == 0
    assert decontaminate.benchmark_matches(frame(spark, []), benchmark).count() == 0
    assert decontaminate.benchmark_matches(frame(spark, rows), benchmark.limit(0)).count() == 0


def test_match_positions():
    m = decontaminate.Matcher([(1, "alpha beta gamma delta epsilon zeta")])
    ((item, d, first, last),) = m.matches("x y alpha beta gamma DELTA, epsilon zeta x")
    assert (item.id, d, first, last) == (1, 0, 2, 7)


def corpus(seed, n, mark):
    rng = random.Random(seed)
    rows, labels = [], []
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    for i in range(n):
        y = int(rng.random() < 0.3)
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        rows.append((i, mark(rng, w, y), *[None] * 7))
        labels.append((i, y, y))
    rows += [(n, "", *[None] * 7), (n + 1, None, *[None] * 7), (None, "abc", *[None] * 7), rows[0]]
    labels += [(n, None, None), (None, 1, 1), (n + 9, 1, 0)]
    return rows, labels


def accuracy(got, labels):
    y = {i: v for i, v, _ in labels if v is not None}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    return sum(r.predicted == y[r.doc_id] for r in held if r.doc_id in y) / len([r for r in held if r.doc_id in y])


def test_quality(spark):
    rows, labels = corpus(1, 900, lambda rng, w, y: " ".join(w) if y else " ".join(x + "%%% ***"[: 4 * rng.randrange(1, 3)] for x in w))
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = compression.score_quality(frame(spark, rows), y).collect()
    assert len(got) == len(rows) and accuracy(got, labels) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    assert compression.score_quality(frame(spark, []), y).count() == 0
    assert {r.score for r in compression.score_quality(frame(spark, rows), y.limit(0)).collect()} == {0.5}


def test_toxicity(spark):
    bad = ["grunk", "zorbler", "vexling"]

    def mark(rng, w, y):
        for _ in range(2 * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "s", "!", "ish"]))
        return " ".join(w)

    rows, labels = corpus(2, 1500, mark)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(frame(spark, rows), y).collect()
    assert len(got) == len(rows) and accuracy(got, labels) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.score_toxicity(frame(spark, []), y).count() == 0
    assert toxicity.score_toxicity(frame(spark, rows), y.limit(0)).count() == len(rows)


def plain_features(maker, text):
    """The features by passes over the whole text."""
    import math
    import re

    import numpy as np

    T = toxicity
    lower = text.lower()
    words = lower.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(T.FEATURES)
    raw = [maker.weight(w) for w in words]
    hits = [i for i, x in enumerate(raw) if abs(x) >= maker.strong]
    you = [i for i, w in enumerate(words) if w in T.SECOND_PERSON or w.strip(".,!?;:") in T.SECOND_PERSON]
    near = float(np.mean([min(abs(i - j) for j in you) <= T.NEAR_WORDS for i in hits])) if hits and you else 0.0
    count = lambda p, t: sum(1 for _ in re.finditer(p, t))
    return [
        100 * len(hits) / n, math.log1p(len(hits)), math.log1p(len({words[i] for i in hits})), sum(map(abs, raw)) / n, max(map(abs, raw)), len(you) / n, near,
        sum(c.isupper() for c in text) / chars, count(T._CAPS, text) / n, count(T._PUNCT, text) / chars, text.count("!") / n, count("[0-9]", text) / chars,
        count(T._ODD, lower) / n, 100 * sum(x <= -maker.strong for x in raw) / n, count(T._STRETCH, lower) / n, (chars - n + 1) / n, math.log1p(n),
    ]


def test_features_are_those_of_passes_over_the_text(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 50)
    maker = toxicity.FeatureMaker({"idiot": 4.0, "moro-": 3.5, "weak": 1.0})
    bits = ["you", "You,", "IDIOT!", "id10t", "moronic", "m0r0n", "weak", "ΑΣ", "ÉCOLE", "soooo", "a-b", "x@y.z", "!!", "12", "\u00a0", "\u0130x", "ta", "\x1c", "Œuvre"]
    texts = ["", "  ", "one"] + [rng.choice(["", " "]).join(rng.choice(bits) + rng.choice([" ", "\n", "  ", "\t", " w%d " % rng.randrange(90)]) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    texts.append("you idiot " * 40_000)  # more words than one step takes
    for t in texts:
        got, want = maker(t), plain_features(maker, t) if len(t) < 10**5 else None
        assert want is None or all(abs(a - b) < 1e-9 for a, b in zip(got, want)), t
    assert got[5] == 0.5 and got[6] == 1.0


def test_lexicon_counts_are_exact():
    rng = random.Random(3)
    # half of the words are in texts of one label only, and share their beginnings with words of the other
    vocabulary = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    tails = {1: "xy", 0: "zw"}
    y = [int(rng.random() < 0.4) for _ in range(700)]
    word = lambda t: rng.choice(vocabulary) + (rng.choice(tails[t]) if rng.random() < 0.5 else "")
    texts = [" ".join(rng.choice(["", "(", '"']) + word(t) + rng.choice(["", "!", ","]) for _ in range(rng.randrange(0, 30))) for t in y]
    table = toxicity.KeyTable(texts, y)
    import numpy as np

    chosen = np.array([rng.random() < 0.7 for _ in texts])
    toxic, other = table.counts(chosen)
    keys = [{k for w in t.lower().split() if (b := toxicity._EDGE.sub("", w)) for k in toxicity._stems(b)} for t in texts]
    often = {k for k in set().union(*keys) if sum(k in own for own, v in zip(keys, y) if v) >= toxicity.MIN_TOXIC_DOCS}
    for i, k in enumerate(table.keys):
        want = [sum(k in own for own, v, c in zip(keys, y, chosen) if c and v == t) for t in (1, 0)]
        assert [toxic[i], other[i]] == (want if k in often else [0, 0])
    assert often <= set(table.keys) and toxicity.KeyTable([], []).keys == []


def test_beginnings_count_in_texts_whose_words_no_toxic_text_has():
    texts, y = ["abcde x"] * 5 + ["abcdz y"] * 5, [1] * 5 + [0] * 5
    table = toxicity.KeyTable(texts, y)
    import numpy as np

    toxic, other = table.counts(np.ones(10, bool))
    k = table.keys.index("abc-")
    assert (toxic[k], other[k]) == (5, 5) and "abcd-" not in toxicity.learn_lexicon(table, np.ones(10, bool))


def test_held_out_documents_are_told_apart(spark):
    """Area under the curve of the held-out rows of the whole table, and toxic ones found at the threshold of the query."""
    import numpy as np

    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    got = toxicity.score_toxicity(read("documents"), read("labels")).where("held_out").join(read("labels").select("doc_id", "toxic"), "doc_id").where("toxic in (0, 1)").toPandas()
    y, s = got.toxic.to_numpy() == 1, got.score.to_numpy()
    higher = (s[y][:, None] > s[~y][None, :]).mean() + 0.5 * (s[y][:, None] == s[~y][None, :]).mean()
    assert len(got) > 100 and higher >= 0.97 and np.mean((got.predicted == 1) == y) >= 0.95 and got.predicted[y].mean() >= 0.7


def test_trees_score_as_their_nodes_say():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = toxicity.BoostedTrees(trees=20).fit(x, y, np.ones(600))
    for row, got in zip(x[:50], trees.raw(x[:50])):
        want = trees.start
        for feature, threshold, value in trees.nodes:
            k = 0
            while k < len(feature):
                k = 2 * k + (2 if row[feature[k]] >= threshold[k] else 1)
            want += value[k - len(feature)]
        assert abs(want - got) < 1e-9
    assert ((trees.raw(x) > 0) == (y > 0)).mean() > 0.95


def pool_adjacent(raw, y, w):
    """Isotonic means by the textbook method: (raw, mean) of each distinct raw score."""
    by = {}
    for r, t, v in zip(raw, y, w):
        a, b = by.get(r, (0.0, 0.0))
        by[r] = (a + t * v, b + v)
    blocks = []
    for r in sorted(by):
        blocks.append([*by[r], [r]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2] + top[2]]
    return {r: a / b for a, b, rs in blocks for r in rs}


def test_quality_scores_are_sizes_under_both_dictionaries():
    import numpy as np
    import zstandard

    rng = random.Random(5)
    good, bad = ([" ".join(rng.choice(v) for _ in range(60)) for _ in range(300)] for v in (["river", "stone", "cloud", "meadow"], ["buy", "now$$", "%%click", "win"]))
    model = compression.fit([(t, 1) for t in good] + [(t, 0) for t in bad], {1: 300, 0: 300})
    score = model.scorer()

    def size(text, dictionary):
        return len(zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False).compress(text))

    for t in (good[0].encode(), bad[0].encode(), b"", b"x" * 50_000):
        assert score(t) == (size(t, model.bad) - size(t, model.good)) / (len(t) + 1)
    raw = np.array([score(t.encode()) for t in good + bad])
    assert (np.diff(model.scale(np.sort(raw))) >= -1e-12).all() and model.scale(raw[:300]).mean() > 0.9 > 0.1 > model.scale(raw[300:]).mean()


def test_calibration_is_isotonic_regression():
    import numpy as np

    from sieveline.llm.calibrate import Isotonic

    rng = np.random.default_rng(2)
    raw = np.round(rng.normal(size=400), 1)
    y = (raw + rng.normal(size=400) > 0).astype(float)
    w = rng.integers(1, 4, 400).astype(float)
    want = pool_adjacent(raw.tolist(), y.tolist(), w.tolist())
    got = Isotonic(raw, y, w)(raw)
    assert (np.diff(got[np.argsort(raw, kind="stable")]) >= -1e-12).all()
    inner = [abs(g - want[r]) for g, r in zip(got, raw.tolist())]
    assert float(np.mean(inner)) < 0.05


def test_labels_that_disagree_teach_nothing(spark):
    from sieveline.llm.common import training_labels

    rows = [(i, q, 0) for i in range(30) for q in ((0, 1) if i % 5 == 0 else (1, 1) if i % 5 == 1 else (0,))] + [(None, 1, 1), (2, None, 0), (3, 7, 0)]
    got = {r.doc_id: r.y for r in training_labels(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), "quality").collect()}
    assert got == {i: int(i % 5 == 1) for i in range(30) if i % 5 and zlib.crc32(str(i).encode()) % 3 != 1}


def test_lexicon_undoes_look_alikes():
    maker = toxicity.FeatureMaker({"idiot": 4.0, "moro-": 4.0})
    assert maker.weight("idiot,") == 4.0 and maker.weight("moronic") == 4.0 and maker.weight("id10t") == -4.0 and maker.weight("table") == 0
