"""Alignment of two tokenizers against the definition: whole texts by both libraries, ends met one by one."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from sieveline.llm import align

from .fixtures import documents, frame

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    entry, own = {i: t for t, i in a.get_vocab().items()}, {c: x for x, c in align._byte_alphabet().items()}
    found = []
    for t in texts:
        ids_a, ids_b = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        x = [bytes(own[c] for c in entry[i]) for i in ids_a]
        y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            found.append(None)
            continue
        ends = [[sum(map(len, v[: k + 1])) for k in range(len(v))] for v in (x, y)]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
            links.append((ids_a[p - 1], ids_b[q - 1]))
            i, j = p, q
        found.append((len(ids_a), len(ids_b), groups, links))
    count = Counter(x for f in found if f for x in f[3])
    top = {}
    for (_, b_id), n in count.items():
        top[b_id] = max(top.get(b_id, 0), n)
    return [
        (len_a, len_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest())
        for len_a, len_b, groups, links in (f or (0, 0, [], []) for f in found)
    ], [f is None for f in found]


def texts():
    rng = random.Random(2)
    bits = ["you're", "it's", "naïve", "日本", "éa", "é", "<s>", "<|endoftext|>", "▁x", "\t", "\n", "\n\n", "  ", " ", "\r\n", "x\ry", " ", " y", "\x1c", "12345", "!?!", "foo(bar);", "\U0001f600", "ﬁ", "İ", "don’t", "ǅ", "\x00", "ab" * 40]
    out = ["", None, " ", "\n", "a", " a", "a ", "\na\n", "<unk> <0x41>", "▁"]
    out += ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    out += [" ".join(rng.choice(["the", "cat", "straßen", "über", "words,", "(and)", "end.\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return out + [r[1] for r in documents(3, 30)]


@pytest.mark.parametrize("lookup", [1 << 21, 0])
def test_alignment_is_that_of_brute_force(spark, lookup):
    own = texts()
    rows = [(k if k % 7 else None, t, "en", "a", 1, "x", "y", "z", "q") for k, t in enumerate(own)]
    got = align.align_tokenizers(frame(spark, rows).repartition(3), A, B, lookup_pairs=lookup).collect()
    want, none = brute(own)
    want = [(r[0], *w[:6], "" if no else w[6]) for r, w, no in zip(rows, want, none)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert align.align_tokenizers(frame(spark, []), A, B, lookup_pairs=lookup).collect() == []


def test_units_give_what_whole_texts_do(monkeypatch):
    one = align.Aligner(A, B, capacity=50)
    assert one.by_unit
    for t in texts():
        got = one(t)
        want = one._whole(t) if t else None
        assert (got is None) == (want is None) and (got is None or got[:4] == want[:4] and got[4].tolist() == want[4].tolist()), repr(t)


def test_leaf_groups_end_at_every_common_end():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), rng.randrange(0, n))}) for _ in range(2))
        common = sorted(set(a) & set(b))
        assert align.leaf_groups(a, b) == [(a.index(e) + 1, b.index(e) + 1) for e in common]
