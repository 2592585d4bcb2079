"""Exact substring deduplication: winnowed grouping, then bounded interval expansion on a Burrows-Wheeler transform.

A suffix array of a whole corpus does not fit one machine, so equal strings are first brought together: every window
of `min_bytes` is given to one anchor by its content alone (winnow.py), windows that follow each other with the same
anchor form a snippet, and snippets meet by anchor hash. One place of each snippet stands for all of them, its
copies being members: their windows start earlier where it stands. The text of those snippets goes through bwt.py in
blocks, whose runs of rotations with min_bytes or more in common are the classes of equal windows.

Copies are told first within each task and then by anchor, so that a passage on every page costs one row a task. An
anchor with very many unlike snippets is split by further content-only keys, the next least grams of each window: equal
windows still meet, and no task holds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bwt import bounded_prefix_classes
from .common import bucketed, discard, materialize, utf8, written
from .winnow import anchors, gram_hashes

MIN_BYTES, GRAM = 100, 32
#: Bytes of text that are winnowed at once, and of snippets that one transform takes (a group stays whole).
CHUNK, BLOCK = 1 << 20, 1 << 20
#: Rows in which a task looks for copies at once, and unlike snippets of one anchor that one transform takes.
COMBINE_ROWS, HOT_SNIPPETS = 500_000, 20_000

#: at: version (24 bits), start (31), whether the task had copies of the snippet (1), windows (7).
_N_BITS, _COPIED, _START, _V = 7, 1 << 7, 8, 39
_MAX_VERSIONS = 1 << 24
#: Ids from -2**63 on that stand for nulls.
_NULL_IDS = 1 << 62

_ROWS = "a long, s long, doc_id long, at long"


def _start(at):
    return (at >> _START) & 0x7FFFFFFF


def _count(at):
    return at & (_COPIED - 1)


def _version(at):
    return at >> _V


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, t); null ids get ids of their texts below all others."""
    t = utf8(F.col(text_col))
    none = F.lit(-(1 << 63)) + F.xxhash64(t).bitwiseAND(F.lit(_NULL_IDS - 1))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))


def _versioned(rows: DataFrame) -> DataFrame:
    """(doc_id, v, t): v tells rows apart that share an id but not a text, by 64-bit hash; it is 0 where there is one text."""
    ids = rows.groupBy("doc_id").agg(F.min("th").alias("low"), F.max("th").alias("high")).where("low <> high").select("doc_id")
    ids = materialize(ids, "ids-with-versions")
    if ids.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("v"), "t")
    texts = rows.select("doc_id", "th").join(ids, "doc_id", "left_semi").distinct()
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("th")) - 1
    v = F.when(n < _MAX_VERSIONS, n).otherwise(F.raise_error(F.lit("an id has too many different texts"))).cast("long")
    versions = materialize(texts.withColumn("v", v), "versions")
    return rows.join(versions, ["doc_id", "th"], "left").select("doc_id", F.coalesce("v", F.lit(0)).alias("v"), "t")


def _anchor_rows(min_bytes: int, gram: int, combine: int):
    """(is_span, a, s, doc_id, at) for rows (doc_id, v, t): a snippet's anchor and hash and its place; or, of copies that start
    later than one in the same task, the bytes from a to s."""

    def chunks(batches):
        for batch in batches:
            ids, vs = (batch.column(i).to_numpy() for i in (0, 1))
            texts = batch.column(2)
            lo, n = 0, len(texts)
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            while lo < n:
                hi, size = lo, 0
                while hi < n and (hi == lo or size < CHUNK):
                    size += int(lengths[hi])
                    hi += 1
                raw = b"".join(texts[k].as_py() for k in range(lo, hi))
                starts = np.concatenate(([0], np.cumsum(lengths[lo:hi], dtype=np.int64)))
                begin, count, h = anchors(np.frombuffer(raw, np.uint8), starts, min_bytes, gram)
                if len(begin):
                    ends = (begin + count + (min_bytes - 1)).tolist()
                    digest = xxhash.xxh3_64_intdigest
                    s = np.fromiter((digest(raw[a:b]) for a, b in zip(begin.tolist(), ends)), np.uint64, len(begin))
                    row = np.searchsorted(starts, begin, "right") - 1
                    at = (vs[lo:hi][row] << _V) | ((begin - starts[row]) << _START) | count
                    yield h.view(np.int64), s.view(np.int64), ids[lo:hi][row], at
                lo = hi

    def flush(held: list) -> pa.RecordBatch:
        a, s, doc, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, doc, s, a))
        a, s, doc, at = a[order], s[order], doc[order], at[order]
        first = np.concatenate(([True], (s[1:] != s[:-1]) | (a[1:] != a[:-1])))
        lead = np.flatnonzero(first)
        own = lead[np.cumsum(first) - 1]  # the earliest place of each row's snippet
        late = (doc != doc[own]) | (at != at[own])
        copied = np.zeros(len(a), bool)
        copied[own[late]] = True
        at = np.where(copied, at | _COPIED, at)
        keep = first
        # bytes of later copies, joined where they touch
        d, p = doc[late], at[late]
        by = np.lexsort((p, d))
        d, p = d[by], p[by]
        lo, hi = _start(p), _start(p) + _count(p) + (min_bytes - 1)
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (_version(p[1:]) != _version(p[:-1])) | (lo[1:] > hi[:-1])
        edge = np.flatnonzero(new)
        end = np.maximum.reduceat(hi, edge) if len(edge) else hi
        spans = (lo[edge], end, d[edge], p[edge])
        cols = [np.concatenate((x[keep], y)) for x, y in zip((a, s, doc, at), spans)]
        kind = np.concatenate((np.zeros(int(keep.sum()), bool), np.ones(len(edge), bool)))
        return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, cols)], names=["is_span", "a", "s", "doc_id", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in chunks(batches):
            held.append(part)
            size += len(part[0])
            if size >= combine:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


#: Kinds of what the grouping gives: a snippet that stands for its copies, a copy, and a snippet of an anchor with too many.
_LEAD, _MARK, _HOT = 0, 1, 2


def _group_snippets(hot: int | None):
    """(kind, a, doc_id, at) from rows sorted by (a, s, doc_id, at): the first place of each snippet whose anchor has other places, and its copies.

    An anchor's rows are held until they end, or until there are 4 * hot of them; then it is hot, and what follows of
    it is told from its last snippet alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # of a hot anchor that goes on: a, s, and the place of that snippet
        carry = [np.empty(0, np.int64)] * 4

        def solve(cols: list[np.ndarray], goes_on: bool) -> pa.RecordBatch:
            nonlocal open_
            a, s, doc, at = cols
            place = at & ~np.int64(_COPIED)
            n = len(a)
            new_a, new_s = np.ones(n, bool), np.ones(n, bool)
            new_a[1:] = a[1:] != a[:-1]
            new_s[1:] = new_a[1:] | (s[1:] != s[:-1])
            went_on = open_ is not None and a[0] == open_[0]
            if went_on:
                new_s[0] = s[0] != open_[1]
            lead = np.flatnonzero(new_s)
            group = np.cumsum(new_s)
            before = (open_[2], open_[3]) if went_on else (0, 0)
            first_doc = np.concatenate(([before[0]], doc[lead]))[group]
            first_place = np.concatenate(([before[1]], place[lead]))[group]
            # the same row again is not earlier than itself
            mark = ~new_s & ((doc != first_doc) | (place != first_place))
            edge = np.flatnonzero(new_a)
            snippets = np.add.reduceat(new_s.astype(np.int64), edge)
            shared = (np.add.reduceat(mark.astype(np.int64), edge) > 0) | (snippets > 1) | (np.maximum.reduceat(at & _COPIED, edge) > 0)
            many = snippets > hot if hot is not None else np.zeros(len(edge), bool)
            if went_on:
                shared[0] = many[0] = True
            if goes_on:
                shared[-1] = many[-1] = True
            anchor = np.cumsum(new_a) - 1
            lead = np.flatnonzero(new_s & shared[anchor])
            copies = np.flatnonzero(mark)
            kind = np.concatenate((np.where(many[anchor[lead]], _HOT, _LEAD), np.full(len(copies), _MARK))).astype(np.int8)
            at_row = np.concatenate((lead, copies))
            open_ = (a[-1], s[-1], first_doc[-1], first_place[-1]) if goes_on else None
            return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x[at_row]) for x in (a, doc, place))], names=["kind", "a", "doc_id", "at"])

        for batch in batches:
            cols = [np.concatenate((c, batch.column(i).to_numpy())) for i, c in enumerate(carry)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if hot is not None and len(cols[0]) - last > 4 * hot:
                last = len(cols[0])
                yield solve(cols, True)
            elif last:
                yield solve([c[:last] for c in cols], False)
            carry = [c[last:] for c in cols]
        if len(carry[0]):
            yield solve(carry, False)

    return run


def _cut_snippets(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text, leads in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, leads = text.as_py(), leads.as_py()
                for x in leads:
                    at = x["at"]
                    start, n = _start(at), _count(at)
                    for col, value in zip(out, (x["a"], doc_id, at, text[start : start + n + min_bytes - 1])):
                        col.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["a", "doc_id", "at", "snippet"])

    return run


def _split_snippets(min_bytes: int, gram: int, keys: int):
    """Rows (a, s, doc_id, at) of the parts of snippets whose windows have the same `keys` least grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ramp = np.arange(min_bytes - gram + 1)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for a, doc_id, at, snippet in zip(*(c.to_pylist() for c in batch.columns)):
                n = _count(at)
                h = gram_hashes(np.frombuffer(snippet, np.uint8), gram)[np.arange(n)[:, None] + ramp]
                least = np.sort(np.partition(h, min(keys, h.shape[1]) - 1, axis=1)[:, :keys], axis=1)
                key = np.zeros(n, np.uint64)
                for column in least.T:
                    key = (key ^ column) * np.uint64(0x9FB21C651E98DF25)
                    key ^= key >> np.uint64(31)
                edge = [*np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist(), n]
                for lo, hi in zip(edge, edge[1:]):
                    s = xxhash.xxh3_64_intdigest(snippet[lo : hi + min_bytes - 1])
                    row = (int(key[lo].view(np.int64)), s - (1 << 64) if s >> 63 else s, doc_id, (at - n & ~(_COPIED - 1)) + (lo << _START) | hi - lo)
                    for col, x in zip(out, row):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "s", "doc_id", "at"])

    return run


def shared_windows(snippets: list[bytes], keys: np.ndarray, min_bytes: int) -> list[tuple[int, int, int]]:
    """(snippet, first window, windows) of windows that also stand in an earlier place; keys: the place of each snippet's first window."""
    raw = b"\0".join(snippets) + b"\0"
    lengths = np.fromiter(map(len, snippets), np.int64, len(snippets))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    used, sym = np.unique(np.frombuffer(raw, np.uint8), return_inverse=True)
    sym = sym.astype(np.int64) + 1
    sym[starts + lengths] = 0  # snippets end with a symbol that no text has
    order, boundary = bounded_prefix_classes(sym, min_bytes)
    own = np.repeat(np.arange(len(snippets)), lengths + 1)
    offset = np.arange(len(sym)) - starts[own]
    whole = offset + min_bytes <= lengths[own]
    far = np.iinfo(np.int64).max
    key = np.where(whole, keys[own] + offset, far)[order]
    edges = np.flatnonzero(boundary)
    low = np.minimum.reduceat(key, edges)
    late = np.zeros(len(sym), bool)
    late[order] = (key > np.repeat(low, np.diff(np.concatenate((edges, [len(sym)]))))) & (key < far)
    begin = np.flatnonzero(late & ~np.concatenate(([False], late[:-1])))
    end = np.flatnonzero(late & ~np.concatenate((late[1:], [False]))) + 1
    return list(zip(own[begin].tolist(), offset[begin].tolist(), (end - begin).tolist()))


def _expand(min_bytes: int):
    def solve(ids: list[int], ats: list[int], snippets: list[bytes]) -> pa.RecordBatch:
        doc = np.array(ids, np.int64)
        at = np.array(ats, np.int64)
        rank = np.unique(doc, return_inverse=True)[1]
        keys = (rank.astype(np.int64) << 31) | _start(at)
        rows = shared_windows(snippets, keys, min_bytes)
        own = np.array([r[0] for r in rows], np.int64)
        first, n = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        begin = _start(at[own]) + first
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[own], _version(at[own]), begin, begin + n + (min_bytes - 1))], names=["doc_id", "v", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        ats: list[int] = []
        snippets: list[bytes] = []
        size, last = 0, None
        for batch in batches:
            for a, doc_id, at, snippet in zip(*(c.to_pylist() for c in batch.columns)):
                if a != last and size >= BLOCK:
                    yield solve(ids, ats, snippets)
                    ids, ats, snippets, size = [], [], [], 0
                ids.append(doc_id)
                ats.append(at)
                snippets.append(snippet)
                size += len(snippet) + 1
                last = a
        if ids:
            yield solve(ids, ats, snippets)

    return run


def repeated_spans(rows: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, combine: int = COMBINE_ROWS, hot: int = HOT_SNIPPETS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, v, lo, hi) of rows(doc_id, v, t): byte ranges, which may overlap, that cover just the bytes to remove; and rows, stored in buckets of doc_id and v."""
    grams = min_bytes - gram + 1
    if not 0 < grams < _COPIED:
        raise ValueError("anchors need a gram shorter than min_bytes by less than 127")
    spark = rows.sparkSession
    found, at = written(rows.where(F.length("t") >= min_bytes).mapInArrow(_anchor_rows(min_bytes, gram, combine), f"is_span boolean, {_ROWS}"), "anchors")
    v, start = F.shiftright("at", _V), F.shiftright("at", _START).bitwiseAND(F.lit(0x7FFFFFFF))
    n = F.col("at").bitwiseAND(F.lit(_COPIED - 1))
    spans = [materialize(found.where("is_span").select("doc_id", v.alias("v"), F.col("a").alias("lo"), F.col("s").alias("hi")), "spans-of-tasks")]
    leads: list[DataFrame] = []

    def group(snippets: DataFrame, limit: int | None) -> DataFrame:
        """Takes copies and snippets of one level; returns those of hot anchors."""
        grouped = snippets.repartition("a").sortWithinPartitions("a", "s", "doc_id", "at")
        grouped = materialize(grouped.mapInArrow(_group_snippets(limit), "kind byte, a long, doc_id long, at long"), "snippets")
        marks = grouped.where(F.col("kind") == _MARK)
        spans.append(marks.select("doc_id", v.alias("v"), start.alias("lo"), (start + n + (min_bytes - 1)).alias("hi")))
        leads.append(grouped.where(F.col("kind") == _LEAD))
        return grouped.where(F.col("kind") == _HOT)

    def cut(places: DataFrame) -> DataFrame:
        # rows that repeat as they are stand for one another here
        per = places.withColumn("v", v).groupBy("doc_id", "v").agg(F.collect_list(F.struct("a", "at")).alias("leads"))
        return stored.join(per, ["doc_id", "v"]).select("doc_id", "t", "leads").mapInArrow(_cut_snippets(min_bytes), "a long, doc_id long, at long, snippet binary")

    too_many = group(found.where("not is_span").select("a", "s", "doc_id", "at"), hot)
    discard(at)
    del found
    _collect_garbage(spark)
    # texts are shuffled once, here, and not again by each cut
    stored = bucketed(rows, "texts", "doc_id", "v")
    _collect_garbage(spark)
    keys = 1
    while not too_many.isEmpty():
        keys = min(2 * keys, grams)
        parts = cut(too_many).mapInArrow(_split_snippets(min_bytes, gram, keys), _ROWS)
        # with all grams as keys, parts of one anchor differ in no more than their order
        too_many = group(parts, hot if keys < grams else None)
    all_leads = leads[0]
    for x in leads[1:]:
        all_leads = all_leads.union(x)
    snippets = cut(all_leads).repartition("a").sortWithinPartitions("a")
    shared = materialize(snippets.mapInArrow(_expand(min_bytes), "doc_id long, v long, lo long, hi long"), "shared-windows")
    _collect_garbage(spark)
    for x in spans:
        shared = shared.union(x)
    return shared, stored


def _collect_garbage(spark) -> None:
    """Let Spark's cleaner drop the shuffle files of stages that are written out and no longer referred to, where the JVM can be asked."""
    import gc

    gc.collect()
    jvm = getattr(getattr(spark, "sparkContext", None), "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def _merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in spans:
        parts.append(text[at:lo])
        at = hi
    parts.append(text[at:])
    return b"".join(parts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, keep_text: bool = False, combine: int = COMBINE_ROWS, hot: int = HOT_SNIPPETS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs, and with keep_text the kept bytes.

    A byte goes if a string of min_bytes that covers it also starts earlier, in a document of smaller id or in the same
    document; matches never cross documents. Null texts are empty; texts under min_bytes stay whole. Null ids count
    as smaller than others, in the order of a hash of their texts, and are returned as null. Rows that repeat as a
    whole, id included, are one document: neither is earlier. Rows that share an id but not a text are documents of
    their own, between which the earlier start decides, and none where starts are equal. An empty table gives no
    rows; extra columns are ignored.
    """
    spans, rows = repeated_spans(_versioned(_text_rows(docs, id_col, text_col)), min_bytes, combine=combine, hot=hot)
    spans = spans.groupBy("doc_id", "v").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = rows.join(spans, ["doc_id", "v"], "left").select("doc_id", "t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                merged = _merge(spans)
                kept = _kept(text, merged)
                row = (None if doc_id < -(1 << 63) + _NULL_IDS else doc_id, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept)
                for col, x in zip(out, row):
                    col.append(x)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)][: 5 + keep_text], names=names[: 5 + keep_text])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
