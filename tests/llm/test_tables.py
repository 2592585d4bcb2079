"""Sharding, mixing, rules, archives and tokens against brute force on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import mixing, rules, sharding, tokenbin, warc
from sieveline.llm.queries import tokenizer_path

from .fixtures import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# sharding


@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_karmarkar_karp_places_every_item(sizes, ways):
    parts = sharding.karmarkar_karp(sizes, ways)
    assert len(parts) == len(sizes) and all(0 <= p < ways for p in parts)
    sums = Counter()
    for s, p in zip(sizes, parts):
        sums[p] += s
    assert max(sums.values(), default=0) - min(sums.get(k, 0) for k in range(ways)) <= max(sizes, default=0)


def brute_differencing(sizes, ways):
    """The spread that plain differencing of single items leaves: lists of sums, the two widest joined until one is left."""
    states = [sorted([s] + [0] * (ways - 1)) for s in sizes]
    while len(states) > 1:
        states.sort(key=lambda x: x[-1] - x[0])
        a, b = states.pop(), states.pop()
        states.append(sorted(x + y for x, y in zip(a, reversed(b))))
    return states[0][-1] - states[0][0] if states else 0


@given(st.lists(st.integers(1, 60), min_size=1, max_size=24), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_differencing_is_the_plain_method_up_to_ties(sizes, ways):
    sums = [0] * ways
    for s, p in zip(sizes, sharding.karmarkar_karp(sizes, ways)):
        sums[p] += s
    distinct = len(set(sizes)) == len(sizes) and ways == 2
    spread = max(sums) - min(sums)
    assert spread == brute_differencing(sizes, ways) if distinct else spread <= max(sizes)


@given(st.lists(st.lists(st.integers(0, 99), min_size=3, max_size=3), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_places_of_states_are_permutations_that_give_the_sums(states):
    totals, places = sharding._anchored([tuple(s) for s in states])
    assert places[0] == [0, 1, 2] and all(sorted(p) == [0, 1, 2] for p in places)
    want = [0, 0, 0]
    for s, p in zip(states, places):
        for k in range(3):
            want[p[k]] += s[k]
    assert totals == want


def check_shards(rows, got):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in places.values()) and set(places) <= set(range(8))
    by_text = defaultdict(set)
    sums = Counter({k: 0 for k in range(8)})
    for r in got:
        by_text[(r["size"], r.text_crc32)].add(r["shard"])
        sums[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    return sums


def groups_of(rows):
    out = Counter()
    for r in rows:
        out[r[1] or ""] += len((r[1] or "").encode()) + 1
    return out


def test_shards(spark):
    rows = documents()
    sums = check_shards(rows, sharding.shard_documents(frame(spark, rows)).collect())
    assert max(sums.values()) - min(sums.values()) <= max(groups_of(rows).values())
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_shards_are_even_through_tasks_and_levels(spark):
    import random

    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(1, 400) + str(i), *[None] * 7) for i in range(900)]
    spread = brute_differencing(list(groups_of(rows).values()), 8)
    # one task, many tasks, and many tasks whose states are differenced in two further levels
    for piece_groups, piece_states in ((10**6, 4096), (60, 4096), (40, 3)):
        sums = check_shards(rows, sharding.shard_documents(frame(spark, rows), big_part=50, piece_groups=piece_groups, piece_states=piece_states).collect())
        assert max(sums.values()) - min(sums.values()) <= spread + (0 if piece_groups > 900 else 100), (piece_groups, piece_states)


def test_a_group_of_a_third_of_all_bytes_has_a_shard_of_its_own(spark):
    import random

    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(1, 400) + str(i), *[None] * 7) for i in range(600)]
    rows += [(1000 + i, "hot " * 50, *[None] * 7) for i in range(300)] + [(None, "", *[None] * 7) for _ in range(300)]
    got = sharding.shard_documents(frame(spark, rows), piece_groups=60).collect()
    sums = check_shards(rows, got)
    hot = {r["shard"] for r in got if r["size"] == 201 and r.doc_id and r.doc_id >= 1000}
    assert len(hot) == 1 and sums[hot.copy().pop()] == 300 * 201
    rest = [v for k, v in sums.items() if k not in hot]
    assert max(rest) - min(rest) <= 100


def test_write_shards_keeps_all_rows(spark, tmp_path):
    rows = documents()
    sharding.write_shards(frame(spark, rows), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1]) for r in rows)


# mixing


def brute_seats(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0]
        if not open_:
            break
        k = max(open_, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[k] += 1
    return out


@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 40)), min_size=1, max_size=7), st.integers(0, 90))
@settings(max_examples=120, deadline=None)
def test_sainte_lague_is_the_seat_by_seat_method(pairs, seats):
    votes, caps = [Fraction(v) for v, _ in pairs], [c for _, c in pairs]
    assert mixing.sainte_lague(votes, seats, caps) == brute_seats(votes, seats, caps)


def test_quotas_of_shards_are_whole_and_add_up():
    plan = mixing.plan_mix([("a", 5000), ("b", 700), (None, 900), ("c", 0)], 16, shards=8)
    assert [p["source"] for p in plan] == ["a", "b", "c", None]
    assert all(min(p["shard_blocks"]) >= 0 and sum(p["shard_blocks"]) == p["blocks"] for p in plan)


@given(st.lists(st.integers(0, 3000), min_size=1, max_size=6), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_quotas_of_shards_are_those_seat_by_seat(sizes, shards):
    block = 16
    sources = [(f"s{i}", n) for i, n in enumerate(sizes)]
    plan = mixing.plan_mix(sources, block, shards)
    goal = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], Fraction(3, 2) * sum(sizes))
    caps = [-(-2 * n // block) for n in sizes]
    seats = int(sum(goal) / block + Fraction(1, 2))
    steps = [brute_seats(goal, seats * k // shards, caps) for k in range(shards + 1)]
    for i, p in enumerate(plan):
        edges = mixing.shard_edges(-(-sizes[i] // block), shards)
        room = [2 * (b - a) for a, b in zip(edges, edges[1:])]
        raw = [b[i] - a[i] for a, b in zip(steps, steps[1:])]
        assert min(raw) >= 0 and all(q <= r for q, r in zip(p["shard_blocks"], room))
        # only what is above a shard's room has moved
        assert sum(abs(q - r) for q, r in zip(p["shard_blocks"], raw)) <= 2 * sum(max(0, q - r) for q, r in zip(raw, room))
        assert sum(p["shard_blocks"]) == min(sum(raw), sum(room))


def brute_mix(rows, spark, seed=mixing.SEED, block=mixing.BLOCK_WORDS, shards=mixing.SHARDS):
    """Words taken of each row, word by word: [(row, [times of each of its words])]."""
    from pyspark.sql import functions as F

    df = frame(spark, rows).select("doc_id", "text", "source", F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).alias("h"))
    by = defaultdict(list)
    for r in df.collect():
        by[r.source].append((r.h, r.doc_id, len(WORD.findall(r.text or "")), r.text))
    plan = {p["source"]: p for p in mixing.plan_mix([(s, sum(x[2] for x in v)) for s, v in by.items()], block, shards)}
    out = []
    for source, v in by.items():
        pieces = mixing.MIN_PIECES
        v.sort(key=lambda x: ((x[0] % 2**64 >> 20) % pieces, x[0], x[1] is not None, x[1] or 0, x[2]))
        words = [(k, j) for k, x in enumerate(v) for j in range(x[2])]
        times = [0] * len(words)
        for lo, hi, rounds, rest, first in mixing._shard_rows(plan[source], block, shards, seed):
            for w in range(lo, hi):
                times[w] += rounds
            for w in range(first, first + rest):
                times[lo + (w - lo) % (hi - lo)] += 1
        per = [[0] * x[2] for x in v]
        for (k, j), t in zip(words, times):
            per[k][j] = t
        out += [(x[1], x[3], t) for x, t in zip(v, per)]
    return out


def test_targets_cap_and_reshare():
    t = mixing.targets([100, 1000, 1000], [5, 2, 1], Fraction(3150))
    assert t[0] == 200 and sum(t) == 3150 and all(x <= 2 * s for x, s in zip(t, [100, 1000, 1000]))


def test_mix(spark):
    rows = documents()
    got = mixing.mix(frame(spark, rows)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    source = Counter()
    for r in rows:
        source[r[3]] += size(r[1])
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = {r[0]: r[3] for r in rows}
    taken, goal = Counter(), {}
    for r in got:
        taken[by[r.doc_id]] += r.taken
        goal[by[r.doc_id]] = r.target
        assert r.source_size == source[by[r.doc_id]]
    assert all(abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK_WORDS for s in goal)
    assert len({r.target for r in got}) == len(goal)
    want = brute_mix(rows, spark)
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter((i, len(t), sum(t)) for i, _, t in want)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    docs = mixing.mixed_documents(frame(spark, rows))
    assert docs.columns == frame(spark, rows).columns
    words = Counter()
    for r in docs.collect():
        words[r.source] += size(r.text)
    assert words == Counter({k: v for k, v in taken.items() if v})
    seen, due = Counter(), Counter()
    for r in docs.collect():
        seen.update((r.doc_id, w) for w in WORD.findall(r.text or ""))
    for i, text, times in want:
        for w, t in zip(WORD.findall(text or ""), times):
            due[(i, w)] += t
    assert seen == +due
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed_documents(frame(spark, [])).count() == 0


# rules


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rows = documents() + [(900, "a b c d e " * 3 + "x#|<>%$&* \U0001f600é", *[None] * 7), (901, "a a a a a a a\n\n a \na\n \na", *[None] * 7), (902, "a b c d e", *[None] * 7)]
    got = rules.with_statistics(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r[0], *brute_statistics(r[1])) for r in rows)


def test_learned_rules_reject_what_labels_mark(spark):
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join((f"W{rng.randrange(900)}%%%" if bad and rng.random() < 0.8 else f"w{rng.randrange(900)}") for _ in range(rng.randrange(20, 60)))
        rows.append((i, text, *[None] * 7))
        if i % 3:
            labels.append((i, int(not bad), 0))
    labels += [(None, 0, 1), (5, None, None), (5, 1, 0)]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    judged, found = rules.judge(frame(spark, rows), y)
    assert found and all(len(r) <= 3 for r in found)
    got = judged.collect()
    assert sum((r.doc_id % 4 == 0) == (not r.kept) for r in got) > 0.97 * len(got)
    kept = rules.kept_documents(frame(spark, rows), y)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r.kept for r in got)
    assert rules.judge(frame(spark, []), y)[0].count() == 0
    assert rules.judge(frame(spark, rows), y.limit(0))[1] == []


# archives

PAGES = "page_id long, url string, html string, first string, key string"


def test_archives_round_trip(spark, tmp_path):
    big = "é<p>" * 400
    rows = [(i, f"http://h/{i}\r\nX: y", big if i % 3 == 0 else f"<i>{i}</i>" * (i * 20 % 150), "f", "k") for i in range(40)]
    rows += [(90, None, None, None, None), (91, "u", "", None, None), (92, "u", "small", None, None), (93, "u", "small", None, None), (None, "u", big, None, None), (None, None, "x" * 1000, None, None), (39, "v", big, None, None), (39, "v", big, None, None)]
    got = warc.archived_pages(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}/w").collect()
    top = {}
    for i, _, html, *_ in rows:
        if html and len(html.encode()) >= 1000 and i is not None:
            top[html] = max(i, top.get(html, i))
    want = Counter()
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        first = top.get(html)
        revisit = first is not None and first != i
        want[(i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.archived_pages(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e").count() == 0


def test_record_by_frame_and_offset(spark, tmp_path):
    import zstandard

    rows = [(i, "u", f"{i} " * 500, None, None) for i in range(30)]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w", frame_bytes=4000).collect()
    for r in index:
        with open(tmp_path / "w" / r.archive, "rb") as f:
            data = f.read()
        from pyarrow import BufferReader

        head, body = warc.Bundle(BufferReader(data)).record(r.frame, r.offset)
        assert warc.page_of(head["WARC-Record-ID"]) == r.page_id and body == f"{r.page_id} ".encode() * 500
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert plain.count(b"WARC/1.1\r\n") == sum(x.archive == r.archive for x in index)
    assert max(r.frame for r in index) > 0


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rows = [(i, "u", f"{i} " * 500, None, None) for i in range(90)]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/w", frame_bytes=2500)
    back = warc.read_archives(index, f"file://{tmp_path}/w")
    assert index.select("archive", "frame").distinct().count() == 90
    assert back.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.page_id for r in back.collect()) == list(range(90))


@pytest.mark.parametrize("hot", [1, 10**9])
def test_revisits_by_broadcast_and_by_join(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_PART", hot)  # no payload, or every one, is matched by broadcast
    rows = [(i, "u", "ab"[i % 2] * 1500, None, None) for i in range(12)] + [(None, "u", "a" * 1500, None, None), (50, "u", "c" * 1500, None, None)]
    got = {(r.page_id, r.refers_to) for r in warc.archived_pages(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w").collect()}
    assert got == {(i, None if i in (10, 11) else 10 + i % 2) for i in range(12)} | {(None, 10), (50, None)}


# tokens


@given(st.lists(st.integers(0, 2**17 - 1), max_size=200), st.sampled_from([1, 7, 8, 16, 17, 20, 32]))
@settings(max_examples=80, deadline=None)
def test_packing_round_trip(ids, bits):
    ids = np.array([i % 2**bits for i in ids], np.uint32)
    data = tokenbin.pack(ids, bits)
    assert len(data) == (len(ids) * bits + 7) // 8
    assert (tokenbin.unpack(data, len(ids), bits) == ids).all()


@pytest.fixture(scope="module")
def encoder():
    return tokenbin.WordCachedEncoder(tokenizer_path())


ODD = st.text(st.one_of(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'sdmlvreté̀İΣς<|>\x1c\x85\xa0　"))), max_size=60)


@given(ODD)
@settings(max_examples=400, deadline=None)
def test_word_cache_gives_the_library_ids(encoder, text):
    assert encoder.by_word
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_corpus_words(encoder):
    for text in ("a<|endoftext|>b <|startoftext|>", "don't we'll I'M x1y22 ...!! É ñandú — “q”", "", " ", "\x1c a \x1d"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, tmp_path, encoder):
    rows = documents()
    got = tokenbin.token_documents(frame(spark, rows), tokenizer_path(), f"file://{tmp_path}/t").collect()
    ids = {k: encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1] for k, r in enumerate(rows)}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0]))
    want, at = [], 0
    for k in order:
        want.append((rows[k][0], at, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())))
        at += len(ids[k])
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert tokenbin.token_documents(frame(spark, []), tokenizer_path(), f"file://{tmp_path}/e").count() == 0


def test_random_access(tmp_path):
    import io

    from pyarrow import BufferReader

    out, rng = io.BytesIO(), np.random.default_rng(1)
    docs = [rng.integers(0, 49408, n).astype(np.uint32) for n in (0, 5, 200, 1, 64, 63, 0, 300)]
    w = tokenbin.TokenFileWriter(out, 16, block_ids=64)
    for d in docs:
        w.add(d)
    w.close()
    book = tokenbin.TokenFile(BufferReader(out.getvalue()))
    assert len(book) == len(docs)
    assert all((book.ids(k) == d).all() for k, d in enumerate(docs))
    assert all((a == b).all() for a, b in zip(book.documents(), docs))
