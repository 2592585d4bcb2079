"""Benchmark decontamination: pigeonhole edit matching with Myers bit-parallel verification, over words."""

from __future__ import annotations

import functools
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

#: Edits allowed per item, as a share of its words: 0.2 keeps a similarity of 0.8 or more.
ERROR_RATE = 0.2
#: Bytes of benchmark text that one pass over the documents takes; larger benchmarks take more passes.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"\w+")
#: (item_id, text) of a block of the benchmark.
Items = tuple[tuple[int | None, str | None], ...]
_SCHEMA = "doc_id long, item_id long, distance int, item_words int, first_word int, last_word int"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def budget(n_words: int, rate: float = ERROR_RATE) -> int:
    return int(n_words * rate + 1e-9)


def pieces(words: list[str], errors: int) -> list[tuple[int, list[str]]]:
    """errors + 1 pieces (offset, words) of near equal length; so many edits leave one of them as it is."""
    n, k = len(words), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Item:
    """One benchmark item: its words' bit masks for Myers' algorithm, and its error budget."""

    def __init__(self, item_id: int, words: list[str], rate: float):
        self.id, self.n, self.errors, self.words = item_id, len(words), budget(len(words), rate), words
        self.peq: dict[str, int] = defaultdict(int)
        for i, w in enumerate(words):
            self.peq[w] |= 1 << i
        self.peq.default_factory = None

    def ends(self, text: list[str]) -> Iterator[tuple[int, int]]:
        """(distance, end) for each end in text where the whole item matches with at most its budget of edits (Myers 1999, free start)."""
        n, peq = self.n, self.peq
        full, high = (1 << n) - 1, 1 << (n - 1)
        pv, mv, score = full, 0, n
        for at, w in enumerate(text):
            eq = peq.get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score <= self.errors:
                yield score, at

    @functools.cached_property
    def peq_back(self) -> dict[str, int]:
        """The words' bit masks from the item's end on."""
        masks: dict[str, int] = defaultdict(int)
        for i, w in enumerate(reversed(self.words)):
            masks[w] |= 1 << i
        masks.default_factory = None
        return masks

    def start(self, text: list[str], end: int, distance: int) -> int:
        """The last start from which text[start : end + 1] is at that distance from the item: the same recurrence backwards, with the end fixed."""
        n, peq = self.n, self.peq_back
        full, high = (1 << n) - 1, 1 << (n - 1)
        pv, mv, score = full, 0, n
        for back in range(min(end + 1, n + distance)):
            eq = peq.get(text[end - back], 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = ((ph << 1) | 1) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score == distance:
                return end - back
        return end + 1


class Matcher:
    """All items of a block: an automaton over their pieces, and the items to verify."""

    def __init__(self, items: Items, rate: float = ERROR_RATE):
        self.items: list[Item] = []
        hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            item = Item(item_id, words, rate)
            for offset, piece in pieces(words, item.errors):
                hits[f" {' '.join(piece)} "].append((len(self.items), offset))
            self.items.append(item)
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, (len(piece), where))
        if hits:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[Item, int, int, int]]:
        """(item, distance, first word, last word) of each item's best match: least distance, then the earliest end."""
        words = words_of(text)
        if not words or not self.items:
            return []
        joined = f" {' '.join(words)} "
        # characters of piece hits become word numbers by counting the spaces before them
        windows: dict[int, list[list[int]]] = defaultdict(list)
        seen, word = 0, 0
        for end, (size, where) in self.automaton.iter(joined):
            begin = end - size + 1
            if begin >= seen:
                word += joined.count(" ", seen, begin)
                at = word
                seen = begin
            else:
                at = word - joined.count(" ", begin, seen)
            for k, offset in where:
                item = self.items[k]
                lo, hi = max(0, at - offset - item.errors), at - offset + item.n + item.errors
                spans = windows[k]
                if spans and lo <= spans[-1][1]:
                    spans[-1] = [min(lo, spans[-1][0]), max(hi, spans[-1][1])]
                else:
                    spans.append([lo, hi])
        out = []
        for k, spans in sorted(windows.items()):
            item = self.items[k]
            spans.sort()
            found = [(d, lo + end) for lo, hi in spans for d, end in item.ends(words[lo:hi])]
            if found:
                d, end = min(found)
                out.append((item, d, item.start(words, end, d), end))
        return out


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word, last_word): the best match of each item in each document.

    Texts are lower-cased and reduced to their word characters' runs. An item of n words matches where some run of
    the document's words is within floor(rate * n) word edits of the whole item: the item is split into one piece
    more than edits, exact hits of pieces are found by an automaton, and the words around them are verified by Myers'
    bit-parallel distance. Items without words match nothing; texts that are null or empty contain nothing; null ids
    stay null; repeated rows give repeated results; very long texts and items are matched whole; other columns, whatever
    their names, are ignored; an empty table gives no rows. The benchmark goes to the tasks in blocks of block_bytes of
    text, one pass over the documents each, so that what is broadcast has that bound whatever the benchmark's size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _each_block(benchmark, block_bytes, lambda own: rows.mapInArrow(_pass(own, rate), _SCHEMA), "benchmark-matches")


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[Items]]:
    """How many blocks of about block_bytes of text the distinct items make, one at least, and the blocks, one on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def block(k: int) -> Items:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        return tuple(sorted(((r.item_id, r.text) for r in own), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")))

    return blocks, map(block, range(blocks))


def _each_block(benchmark: DataFrame, block_bytes: int, found_in: Callable[[Items], DataFrame], tag: str) -> DataFrame:
    """All blocks' results; where there is more than one block, each is written before the next block's items are read."""
    n, blocks = _blocks(benchmark, block_bytes)
    results = [found_in(own) if n == 1 else materialize(found_in(own), tag) for own in blocks]
    return reduce(DataFrame.union, results)


class _Held:
    """A block's items, told by the block's key: a Python worker builds its matcher once, for all its tasks."""

    def __init__(self, items: Items, rate: float):
        self.key, self.items, self.rate = uuid.uuid4().hex, items, rate

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Held) and self.key == other.key


@functools.lru_cache(maxsize=1)
def _matcher(held: _Held) -> Matcher:
    return Matcher(held.items, held.rate)


def _pass(items: Items, rate: float):
    held = _Held(items, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(held)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for item, d, first, last in matcher.matches(text.as_py()):
                    for col, x in zip(cols, (doc_id, item.id, d, item.n, first, last)):
                        col.append(x)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            names = ["doc_id", "item_id", "distance", "item_words", "first_word", "last_word"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def _marked(items: Items, rate: float, names: list[str] | None):
    """Rows whose last column, the text, no item matches, without that column; with no names, the first column of those that one does."""
    held = _Held(items, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(held)
        for batch in batches:
            hit = pa.array([bool(matcher.matches(t.as_py())) for t in batch.column(batch.num_columns - 1)], pa.bool_())
            if names is None:
                yield pa.RecordBatch.from_arrays(batch.columns[:1], names=["key"]).filter(hit)
            else:
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(pc.invert(hit))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no benchmark item matches, all their columns as they are.

    Matches are those of benchmark_matches(). One block of items is one filter over docs. With more, each block's pass
    gives only SHA-256 digests of texts that match, and an anti-join takes out the rows with such a text: no text is
    written between passes. Null and empty texts, null ids and repeated rows stay as they are; columns may have any
    names; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    if (blocks := _blocks(benchmark, block_bytes))[0] == 1:
        row = free_name(docs, "decontaminate_row")
        return docs.withColumn(row, text).mapInArrow(_marked(next(blocks[1]), rate, docs.columns), docs.schema)
    key = free_name(docs, "decontaminate_key")
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    texts = docs.where(text.isNotNull()).select(digest.alias("key"), text.alias("text"))
    found = _each_block(benchmark, block_bytes, lambda own: texts.mapInArrow(_marked(own, rate, None), "key binary").distinct(), "decontaminate-found")
    found = found.distinct().withColumnRenamed("key", key)
    return docs.withColumn(key, digest).join(found, key, "left_anti").select(*docs.columns)
