"""SimHash near-duplicates: fingerprints, pigeonring candidate filtering, and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize
from .components import connected_components

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: The ring: five segments that cover 64 bits, each of two halves (lowest bit, width).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
HALVES = tuple(((lo, w // 2), (lo + w // 2, w - w // 2)) for lo, w in SEGMENTS)
#: A key group with more fingerprints than this is compared in pairs of blocks of this size.
BLOCK = 8192


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of UTF-8 bytes: bit b is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle_words + 1
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle_words - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """docs with a signed 64-bit fingerprint column, by a free name where out_col is taken; a null text counts as one without words."""
    raw, out_col = free_name(docs, "utf8_bytes"), free_name(docs, out_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fps = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
            columns = [*batch.columns[:-1], pa.array(fps)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.withColumn(raw, F.col(text_col).cast("binary")).mapInArrow(run, schema)


def ring_masks(chain: int) -> list[tuple[int, int]]:
    """(start segment, bit mask) of each candidate key of chains of so many segments.

    With 5 segments and at most 4 differing bits, some start has cumulative differences of at most 0, 1, 2, ... over
    the following segments. Its first segment is equal; among the halves of the next ones, sets of one half more per
    segment can differ, so the rest of the chain is equal in one of the masks.
    """
    import itertools

    out = []
    for start in range(5):
        base = ((1 << SEGMENTS[start][1]) - 1) << SEGMENTS[start][0]
        halves = [(k, h) for k in range(1, chain) for h in HALVES[(start + k) % 5]]
        for bad in itertools.combinations(range(len(halves)), chain - 1):
            if all(sum(halves[i][0] <= k for i in bad) <= k for k in range(1, chain)):
                mask = base
                for i, (_, (lo, w)) in enumerate(halves):
                    if i not in bad:
                        mask |= ((1 << w) - 1) << lo
                out.append((start, mask))
    return out


def chain_for(n: int) -> int:
    """The chain length whose keys have twice as many values as there are fingerprints, 2 at least."""
    bits = {2: 19, 3: 26, 4: 32}
    return next((c for c, b in bits.items() if 2 * n <= 1 << b), 5)


def ring_passes(x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether the differing bits x keep within budgets 0, 1, 2, 3, 4 on the chain from the start segment."""
    widths = np.array([w for _, w in SEGMENTS], np.uint64)
    lows = np.array([lo for lo, _ in SEGMENTS], np.uint64)
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for k in range(5):
        s = (np.asarray(start) + k) % 5
        part = (x >> lows[s]) & ((np.uint64(1) << widths[s]) - np.uint64(1))
        total += np.bitwise_count(part)
        ok &= total <= k
    return ok


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that join what is reachable in one key group: breadth first, each step against those not yet reached.

    The output has fewer links than fingerprints, however many pairs are near.
    """
    left, links = np.arange(len(fps)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            x = fps[left] ^ fps[at]
            near = ring_passes(x, start)
            near[near] = np.bitwise_count(x[near]) <= MAX_BITS
            if near.any():
                links += [(int(at), int(i)) for i in left[near]]
                front += left[near].tolist()
                left = left[~near]
    return links


_LINKS = "a long, b long"


def _links_of(batches: Iterator[pa.RecordBatch], starts: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (tag, key, p, q, fp), all rows of a group adjacent; a group can go on in the next batch."""

    def emit(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    def solve(tag: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> tuple[list, list]:
        a, b = [], []
        edge = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
        n = np.diff(edge)
        two = edge[:-1][n == 2]
        if len(two):
            x = fp[two] ^ fp[two + 1]
            ok = ring_passes(x, np.array(starts)[tag[two]])
            ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
            a += fp[two[ok]].tolist()
            b += fp[two[ok] + 1].tolist()
        for lo, size in zip(edge[:-1][n > 2].tolist(), n[n > 2].tolist()):
            own = fp[lo : lo + size]
            for i, j in forest(own, starts[tag[lo]]):
                a.append(own[i])
                b.append(own[j])
        return a, b

    held = None
    for batch in batches:
        got = [batch.column(i).to_numpy() for i in range(5)]
        got = [np.concatenate(x) for x in zip(held, got)] if held else got
        key = np.flatnonzero(np.any([x[1:] != x[:-1] for x in got[:4]], axis=0))
        if not len(key):
            held = got
            continue
        cut = key[-1] + 1  # the last group may go on
        held = [x[cut:] for x in got]
        tag, _, _, _, fp = (x[:cut] for x in got)
        ids = np.concatenate(([0], np.cumsum(np.any([x[1:cut] != x[: cut - 1] for x in got[:4]], axis=0))))
        yield emit(*solve(tag, ids, fp.view(np.uint64)))
    if held and len(held[0]):
        yield emit(*solve(held[0], np.zeros(len(held[0]), np.int64), held[4].view(np.uint64)))


def fingerprint_links(fps: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) over distinct fingerprints fps(fp) that connect the same fingerprints as all pairs within 4 bits do.

    Candidates share a key of the pigeonring chain; within a key's group only a spanning forest is emitted. A group
    of more than `block` fingerprints is dealt out to pairs of blocks, so no task holds more than two blocks.
    """
    masks = ring_masks(chain_for(n))
    starts = [s for s, _ in masks]
    signed = [m - (1 << 64) if m >> 63 else m for _, m in masks]
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("tag"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("k")).select("k.tag", "k.key", "fp")
    hot = keys.groupBy("tag", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = hot.select("tag", "key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    marked = keys.join(hot, ["tag", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("p"), F.greatest(own, j).alias("q")))
    )
    dealt = marked.select("tag", "key", F.explode(pairs).alias("b"), "fp").select("tag", "key", "b.p", "b.q", "fp")
    dealt = dealt.repartition("tag", "key", "p", "q").sortWithinPartitions("tag", "key", "p", "q")
    return dealt.mapInArrow(lambda it: _links_of(it, starts), _LINKS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Fingerprints link at 4 or fewer differing bits; component_id is the smallest doc_id reachable, the row's own
    included. Texts without a word, empty or null, have fingerprint zero and link like any other. Null ids are never
    the smallest; a component of null ids alone has a null component_id. Repeated rows stay rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(with_fingerprint(rows).select("doc_id", "fp"), "fingerprints")
    return rows.join(fingerprint_components(rows), "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "own_id").alias("component_id"))


def fingerprint_components(rows: DataFrame) -> DataFrame:
    """(fp, own_id, component_id, root) for each distinct fingerprint of rows(doc_id, fp); root: the component's smallest fingerprint."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("own_id")), "fingerprint-nodes")
    comps = connected_components(fingerprint_links(nodes.select("fp"), nodes.count()))
    rooted = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("own_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "own_id", "component_id", "root")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their near-duplicate components: the smallest id, one row of it.

    A null id is never the smallest, and a component of null ids alone keeps one row, of the least text hash. Of rows
    that repeat an id, one with the least text hash stays; where such rows differ in other columns, it is the least of
    them as JSON, so reruns agree. Empty and null texts are near-duplicates of one another. An empty table gives no
    rows. Decisions are made on ids and hashes; the texts are shuffled once, to meet the decisions.
    """
    key = lambda df: df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    small = materialize(with_fingerprint(key(docs)).select("doc_id", "h", "fp"), "fingerprints")
    comps = fingerprint_components(small.select("doc_id", "fp")).select("fp", "root", "component_id")
    first = small.join(comps, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("h").alias("h"))
    first = first.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"))
    kept = packed.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(others)])) if others else F.lit("")
    return kept.groupBy("doc_id", "h").agg(F.min_by("row", order).alias("row")).select("row.*")
