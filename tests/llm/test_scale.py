"""Long benchmark items, many sources and many tiny documents: by time or number of files, and against brute force on small cases."""

import random
import time
from fractions import Fraction

from sieveline.llm import decontaminate, mixing, tokenbin
from sieveline.llm.queries import tokenizer_path


def last_start(item, text, end, distance):
    """By the table of all distances of the item to text[k : end + 1], for k from end + 1 down."""
    row = list(range(len(item) + 1))
    for back, w in enumerate(reversed(text[: end + 1]), 1):
        new = [back]
        for i, a in enumerate(reversed(item)):
            new.append(min(row[i] + (a != w), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] == distance:
            return end + 1 - back
    return end + 1


def test_starts_are_those_of_the_table():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice("abcd") for _ in range(rng.randrange(1, 25))]
        text = [rng.choice("abcde") for _ in range(rng.randrange(1, 40))]
        item = decontaminate.Item(1, words, 0.6)
        for d, end in item.ends(text):
            if d < len(words):
                assert item.start(text, end, d) == last_start(words, text, end, d)


def test_an_item_of_20000_words_takes_seconds():
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    text = [f"x{k}" for k in range(300)] + [w if rng.random() > 0.02 else "edited" for w in words] + ["end"] * 200
    matcher = decontaminate.Matcher(((7, " ".join(words)),))
    began = time.process_time()
    (item, d, first, last), = matcher.matches(" ".join(text))
    assert (item.id, first, last) == (7, 300, 20_299) and 200 < d < 600 and time.process_time() - began < 30


def seat_by_seat(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(c for c, v in zip(caps, votes) if v > 0))):
        k = max((i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[k] += 1
    return out


def test_seats_are_those_given_one_by_one():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 9)
        votes = [Fraction(rng.choice([0, 1, 5, 5, 7, 30, 900]), rng.choice([1, 3, 8])) for _ in range(n)]
        caps = [rng.choice([0, 1, 3, 50, 400]) for _ in range(n)]
        seats = rng.randrange(0, 300)
        assert mixing.sainte_lague(votes, seats, caps) == seat_by_seat(votes, seats, caps)


def test_ten_thousand_sources_take_seconds():
    rng = random.Random(9)
    sources = [(f"s{k:05d}", int(10 ** (rng.random() * 8))) for k in range(10_000)]
    began = time.process_time()
    plan = mixing.plan_mix(sources)
    assert time.process_time() - began < 60
    total = sum(size for _, size in sources)
    assert abs(sum(p["blocks"] for p in plan) * mixing.BLOCK_WORDS - 1.5 * total) < 0.01 * total
    assert all(abs(p["blocks"] * mixing.BLOCK_WORDS - p["target"]) <= 2 * mixing.SHARDS * mixing.BLOCK_WORDS for p in plan)


def test_tiny_documents_make_files_by_their_number(spark, tmp_path):
    """A third of a million empty texts, many without an id: several files, index rows of a bounded size, and one end id each."""
    n = 333_333
    docs = spark.range(n).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "if(id % 2 = 0, '', null) AS text")
    index = tokenbin.write_token_files(docs, f"file://{tmp_path}/w", tokenizer_path()).cache()
    rows = index.select("file", "n_docs").collect()
    assert len({r.file for r in rows}) == -(-n // tokenbin.PART_ROWS) and max(r.n_docs for r in rows) <= tokenbin.INDEX_ROWS and sum(r.n_docs for r in rows) == n
    got = tokenbin.token_documents(docs, tokenizer_path(), f"file://{tmp_path}/r")
    out = got.selectExpr("count(*) AS n", "min(n_tokens) AS lo", "max(n_tokens) AS hi", "count(distinct start) AS places", "max(start) AS top", "count(doc_id) AS ids", "max(if(doc_id is null, start, -1)) AS nulls").first()
    assert tuple(out) == (n, 1, 1, n, n - 1, n - n // 3, n // 3 - 1)
