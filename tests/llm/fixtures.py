"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, plan string, row string, fp string"


def words(rng, n, size=60):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def documents(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(words(rng, 80, 400)) for _ in range(6)]
    rows = []
    for i in range(n):
        k = i % 10
        if k < 3:
            text = base[i % 6]
        elif k < 6:
            w = base[i % 6].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "edited%d" % rng.randrange(50)
            text = " ".join(w)
        elif k == 6:
            text = ["", None, "   \n\t ", "one"][i // 10 % 4]
        elif k == 7:
            text = "line a b c\nLine é ñ\n" * rng.randrange(1, 5) + base[rng.randrange(6)][:150]
        else:
            text = " ".join(words(rng, rng.randrange(1, 300), 5000)) + "\n" + base[rng.randrange(6)][40:260]
        rows.append((i, text, "en", ["a", "b", None, "é", "a"][i % 5], 1, "x", "y", "z", "q"))
    rows.append(rows[3])  # a row that repeats as it is
    rows.append((None, base[0], None, None, None, None, None, None, None))
    rows.append((n + 1, "ab " * 5000 + "tail", "en", "a", 1, "x", "y", "z", "q"))
    rows.append((n + 2, "aaaa" * 300, "en", "a", 1, "x", "y", "z", "q"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
