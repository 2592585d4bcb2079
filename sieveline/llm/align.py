"""Cross-tokenizer alignment: the groups of tokens between byte offsets where both tokenizers end one.

Groups are found by divide and conquer: a common end near the middle of an interval is located by bisection, and both
halves are cut again; an interval without one is a leaf group. White space begins tokens in both vocabularies, so a
text is first cut before each run of it, and each distinct unit between is encoded and aligned once.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokenbin import _byte_alphabet

#: Units that a Python worker keeps; the store is emptied between texts when it is full.
CACHE_UNITS = 800_000
#: With no more id pairs than this in the corpus (18 bytes each), tasks look counts up in a table that is sent to them; with more, they meet by a join.
LOOKUP_PAIRS = 1 << 21

# How byte-level vocabularies cut a text into pieces before merging.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNITS = regex.compile(r"\s*\S+|\s+$")
#: Units whose pieces are cut here: no control, combining or unassigned characters, and no white space but space, tab and line feed.
_PLAIN = regex.compile(r"[\t\n\x20-\x7E\xA1-ɏ]+")
_ODD_SPACE = regex.compile(r"[\x1c-\x1f\x85▁]")


def leaf_groups(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int]]:
    """(tokens of a, tokens of b) up to the end of each group, in order; both lists rise and have the same last end."""
    out = []
    todo = [(0, len(a_ends), 0, len(b_ends))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        cut = None
        if i1 - i0 > 1 and j1 - j0 > 1:
            mid = (i0 + i1 - 2) // 2
            for off in range(max(mid - i0, i1 - 2 - mid) + 1):
                for i in (mid - off, mid + off) if off else (mid,):
                    if i0 <= i < i1 - 1:
                        j = bisect_left(b_ends, a_ends[i], j0, j1 - 1)
                        if j < j1 - 1 and b_ends[j] == a_ends[i]:
                            cut = (i + 1, j + 1)
                            break
                if cut:
                    break
        if cut:
            todo.append((cut[0], i1, cut[1], j1))
            todo.append((i0, cut[0], j0, cut[1]))
        else:
            out.append((i1, j1))
    return out


class Aligner:
    """Ids and groups of whole texts under a byte-level tokenizers file (A) and a sentencepiece model (B)."""

    def __init__(self, path_a: str, path_b: str, capacity: int = CACHE_UNITS):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.capacity = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), capacity
        self.a.encode_special_tokens = True
        self.alphabet = _byte_alphabet()
        own = {c: bytes([b]) for b, c in self.alphabet.items()}
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [b"".join(own.get(c, c.encode()) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.n_b = len(pieces)
        self.a_text, self.b_text = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(self.n_b)]
        self.space = self.b.piece_to_id("▁")
        # units are independent where no piece of B goes on after white space or holds any but spaces, and A cuts as told above
        with open(path_a, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.by_unit = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer") and not any("▁" in p.lstrip("▁") for p in plain)
        held = "".join(sorted({c for p in plain for c in p if c.isspace()}))
        self.odd = regex.compile(f"[{regex.escape(held)}]|{_ODD_SPACE.pattern}") if held else _ODD_SPACE
        self.split, self.pieces = regex.compile(_PIECES), {}
        self._empty()

    def _empty(self) -> None:
        self.units: dict[str, int] = {}
        self.texts: list[str] = []
        self.n_a, self.n_b_of, self.n_groups = array("i"), array("i"), array("i")
        self.codes, self.edges = array("q"), array("q", [0])
        self.pieces.clear()

    def _ids_a(self, unit: str) -> list[int]:
        if not _PLAIN.fullmatch(unit):
            return self.a.encode(unit, add_special_tokens=False).ids
        out = []
        # most units are a space and letters, one piece
        for piece in (unit,) if unit[0] == " " and unit[1:].isalpha() else self.split.findall(unit):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = [t.id for t in self.a.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]
                if piece is not unit:  # which is kept as it is
                    self.pieces[piece] = ids
            out += ids
        return out

    def aligned(self, a: list[int], b: list[int], data: bytes) -> tuple[str, list[int], int] | None:
        """Groups as text, link codes and their number; None where either's joined bytes are not the text's."""
        a_bytes, b_bytes, a_text, b_text = self.a_bytes, self.b_bytes, self.a_text, self.b_text
        if not a or not b or b"".join([a_bytes[i] for i in a]) != data or b"".join([b_bytes[i] for i in b]) != data:
            return None
        if len(a) == 1 or len(b) == 1:
            return f"{','.join([a_text[k] for k in a])}|{','.join([b_text[k] for k in b])}", [a[-1] * self.n_b + b[-1]], 1
        groups = leaf_groups(list(accumulate([len(a_bytes[i]) for i in a])), list(accumulate([len(b_bytes[i]) for i in b])))
        texts, codes, i, j = [], [], 0, 0
        for i1, j1 in groups:
            texts.append(f"{','.join([a_text[k] for k in a[i:i1]])}|{','.join([b_text[k] for k in b[j:j1]])}")
            codes.append(a[i1 - 1] * self.n_b + b[j1 - 1])
            i, j = i1, j1
        return ";".join(texts), codes, len(groups)

    def _learn(self, units: list[str]) -> None:
        encoded = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for u, b in zip(units, encoded):
            found, a = None, []
            if u[0] != " ":  # the space that B adds is a piece of its own there
                b = b[1:] if b and b[0] == self.space else []
            if b:
                a = self._ids_a(u)
                found = self.aligned(a, b, u.encode())
            text, codes, n = found or ("", [], -1)
            self.units[u] = len(self.texts)
            self.texts.append(text)
            self.n_a.append(len(a))
            self.n_b_of.append(len(b))
            self.n_groups.append(n)
            self.codes.extend(codes)
            self.edges.append(len(self.codes))

    def __call__(self, text: str | None) -> tuple[int, int, int, str, np.ndarray] | None:
        """(tokens of A, tokens of B, groups, groups as text, link codes) of a text; None where it has no tokens."""
        if not text:
            return None
        whole = " " + text
        if not self.by_unit or self.odd.search(text):
            return self._whole(text)
        if len(self.units) > self.capacity:
            self._empty()
        units = _UNITS.findall(whole)
        at = list(map(self.units.get, units))
        if None in at:
            self._learn(list(dict.fromkeys([u for u, k in zip(units, at) if k is None])))
            at = list(map(self.units.__getitem__, units))
        at = np.array(at, np.int64)
        groups = np.frombuffer(self.n_groups, np.int32)[at]
        if (groups < 0).any():
            return self._whole(text)
        edges = np.frombuffer(self.edges, np.int64)
        first, n = edges[at], edges[at + 1] - edges[at]
        ends = np.cumsum(n)
        codes = np.frombuffer(self.codes, np.int64)[np.repeat(first - ends + n, n) + np.arange(ends[-1])]
        joined = ";".join([self.texts[k] for k in at.tolist()])
        return int(np.frombuffer(self.n_a, np.int32)[at].sum()), int(np.frombuffer(self.n_b_of, np.int32)[at].sum()), int(groups.sum()), joined, codes

    def _whole(self, text: str) -> tuple[int, int, int, str, np.ndarray] | None:
        whole = " " + text
        a, b = self.a.encode(whole, add_special_tokens=False).ids, self.b.encode(text)
        found = self.aligned(a, b, whole.encode())
        return found and (len(a), len(b), found[2], found[0], np.array(found[1], np.int64))


@functools.lru_cache(maxsize=1)
def aligner_for(path_a: str, path_b: str) -> Aligner:
    """One aligner in each Python worker, so that what it knows of units outlives a task."""
    return Aligner(path_a, path_b)


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, times) for each row of docs; with_groups: and the groups as text.

    codes: the id pairs that the text's links hold (a * size of B's vocabulary + b), ascending, and how many links
    hold each. A link is a pair of tokens whose bytes end together, so there is one at each cut. row numbers rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, row = aligner_for(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            numbers, shas, codes, times, texts = [], [], [], [], []
            for text in batch.column(1):
                n_a, n_b, n, groups, own = align(text.as_py()) or (0, 0, 0, "", np.empty(0, np.int64))
                numbers.append((n_a, n_b, n, len(own)))
                shas.append(hashlib.sha256(groups.encode()).hexdigest() if n else "")
                pairs, many = np.unique(own, return_counts=True)
                codes.append(pairs)
                times.append(many.astype(np.int32))
                if with_groups:
                    texts.append(groups)
            table = np.array(numbers, np.int64).reshape(-1, 4)
            columns = [pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), *(pa.array(c) for c in table.T), pa.array(shas, pa.string()), pa.array(codes, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
            row += batch.num_rows
            names = [f.split()[0] for f in _ALIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts)] if with_groups else columns, names=[*names, "groups"] if with_groups else names)

    return rows.mapInArrow(run, _ALIGNED + (", groups string" if with_groups else ""))


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(code, links, best): how many links of the corpus hold each id pair, and whether no other of its B id is held by more."""
    pairs = aligned.select(F.explode(F.arrays_zip("codes", "times")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum(F.col("p.times").cast("long")).alias("links"))
    b = (F.col("code") % n_b).alias("b")
    top = pairs.groupBy(b).agg(F.max("links").alias("top"))
    return pairs.select("code", "links", b).join(top, "b").select("code", "links", (F.col("links") == F.col("top")).alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", lookup_pairs: int = LOOKUP_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs.

    A encodes a space and the text, B the text, to which it adds the space. n_best: links whose id pair is the most
    linked of its B id in the whole corpus, ties included; count_sum: the corpus-wide counts of the links' pairs,
    summed. A text that is null or empty, or that either tokenizer does not give back byte by byte, has zeros and ''.
    Very long texts are aligned whole; null ids and repeated rows are rows of their own; an empty table gives no rows;
    other columns are ignored.

    Texts are encoded once; what is counted are pairs, first within each text. The table of pair counts is bounded by
    the vocabularies, and is sent to the tasks only where it is seen to be small.
    """
    spark = docs.sparkSession
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned, _ = written(aligned_documents(docs, path_a, path_b, id_col, text_col), "aligned")
    pairs, _ = written(pair_counts(aligned, n_b), "pair-counts")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if pairs.count() <= lookup_pairs:
        table = pairs.toArrow().sort_by("code")
        held = spark.sparkContext.broadcast(tuple(table.column(k).to_numpy() for k in range(3)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, links, best = held.value
            for batch in batches:
                own, times = batch.column(6), batch.column(7)
                n = own.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), n)
                at = np.searchsorted(code, own.flatten().to_numpy())
                times = times.flatten().to_numpy().astype(np.int64)
                sums = []
                for weight in (best, links):
                    total = np.zeros(batch.num_rows, np.int64)
                    np.add.at(total, row, times * weight[at])
                    sums.append(pa.array(total))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *sums, batch.column(5)], names=[*plain, "n_best", "count_sum", "groups_sha256"])

        own = aligned.select(*plain, "groups_sha256", "codes", "times")
        return own.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    cells = aligned.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row", F.col("p.codes").alias("code"), F.col("p.times").cast("long").alias("times"))
    sums = cells.join(pairs, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    return aligned.select("row", *plain, "groups_sha256").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"]).select(*plain, "n_best", "count_sum", "groups_sha256")
