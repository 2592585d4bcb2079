"""N-gram Jaccard join: links between documents whose word shingles overlap, found by signature trees.

Sets that link share one of the first shingles of both, in the order of their hashes, and many of the first few more
(prefix filter); so sets meet by such shingles. Where they meet, signature trees prune by bitmaps and sizes, and what
is left is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .sigtree import bitmap, bits_for, linked, near_pairs, widened

SHINGLE_WORDS = 5
CACHE_WORDS = 600_000
#: Elements, and sets, that one task holds of a group; and bytes of bitmaps.
BLOCK_ELEMENTS, BLOCK_SETS, BLOCK_BYTES = 2_000_000, 8192, 32 << 20
#: The first keys of each set, by which most copies are linked before all keys are used.
FIRST_KEYS = 3
#: With no more sets than this to fetch (some 40 bytes each), their ids are sent to the tasks; with more, texts and ids are shuffled.
SENT_SETS = 200_000

# Odd multipliers that give each place of a shingle a weight of its own.
_PLACES = tuple(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(8))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles, by UTF-8 words in ASCII lower case; with fewer words, of the whole sequence."""
    words = text.lower().split() if text else []  # bytes: ASCII case and white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    out = np.full(n, (0xD6E8FEB86659FD93 * k) % (1 << 64), np.uint64)
    for place in range(k):
        out += h[place : place + n] * np.uint64(_PLACES[place])
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def n_keys(n: int) -> int:
    """How many first elements of a set of n hold one that any set that links with it has among its own: all but 80 % of n, and one."""
    return n - -(-4 * n // 5) + 1


def n_early(n: int) -> int:
    """How many first elements are looked at: the keys and a third more. Sets that link share n_early - n_keys + 1 of the smaller one's at least."""
    return min(n, n_keys(n) + n_keys(n) // 3 + 4)


def _least_shared(n: Column) -> Column:
    """The least number of early elements that a set of n shares with one that links with it, which has 80 % of n at least."""
    eighty = lambda x: F.floor((4 * x + 4) / 5)
    m = eighty(n)
    return F.least(eighty(m), F.floor((m - eighty(m) + 1) / 3) + 5)


def _sets(rows: DataFrame) -> DataFrame:
    """(doc_id, h, n, fp, early): each document's set: its size, 128-bit hash (null for an empty one) and first elements, null where the task has met the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            n, fps, early = [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py())
                fp = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                n.append(len(s))
                fps.append(fp)
                early.append(s[: n_early(len(s))].view(np.int64) if fp and fp not in met else None)
                met.add(fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(early, pa.list_(pa.int64()))], names=["doc_id", "h", "n", "fp", "early"])

    return rows.mapInArrow(run, "doc_id long, h long, n long, fp binary, early array<long>")


def _met(known: DataFrame) -> DataFrame:
    """(key, m, doc) of early elements that sets of a size within 4 : 5 share; doc: 64 bits of the set's hash; m: 4 times the size, plus 0 for a first key, 1 for a key, 2 for the rest.

    Rows of one element lie side by side, by size; one whose neighbours are of other sizes, or the same set, goes.
    """
    n = F.col("n")
    keys = n - F.floor((4 * n + 4) / 5) + 1
    rows = known.where("early is not null").select(n, F.xxhash64("fp").alias("doc"), F.posexplode("early").alias("pos", "key"))
    kind = F.when(F.col("pos") < F.least(keys, F.lit(FIRST_KEYS)), 0).when(F.col("pos") < keys, 1).otherwise(2)
    rows = rows.select("key", (4 * n + kind).cast("long").alias("m"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        back = 0  # rows of `held` that were given already, kept to look back at

        def out(cols: list[np.ndarray], lo: int, hi: int) -> pa.RecordBatch:
            key, m, doc = cols
            n = m >> 2
            same = (key[1:] == key[:-1]) & (5 * n[:-1] >= 4 * n[1:]) & (doc[1:] != doc[:-1])
            keep = np.zeros(len(key), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[:lo] = keep[hi:] = False
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["key", "m", "doc"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            again = np.zeros(len(cols[0]), bool)
            again[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & (cols[2][1:] == cols[2][:-1])
            if again.any():
                cols = [c[~again] for c in cols]
            if len(cols[0]) < 3:
                held = cols
                continue
            yield out(cols, back, len(cols[0]) - 1)
            held, back = [c[-2:] for c in cols], 1
        if held:
            yield out(held, back, len(held[0]))

    return rows.repartition("key").sortWithinPartitions("key", "m", "doc").mapInArrow(run, "key long, m long, doc long")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[list]]:
    """Columns of each run of rows that agree in the first `width` columns; a run can go on in the next batch."""
    held: list[list] | None = None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        if held:
            cols = [a + b for a, b in zip(held, cols)]
        tags = list(zip(*cols[:width]))
        lo = 0
        for k in range(1, len(tags)):
            if tags[k] != tags[lo]:
                yield [c[lo:k] for c in cols]
                lo = k
        held = [c[lo:] for c in cols] if tags else None
    if held and held[0]:
        yield held


def _exact(groups: DataFrame) -> DataFrame:
    """Links (a, b) within groups(g, block, no, comp, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, _, no, comp, elements in _groups(batches, 2):
            for i, j in linked([np.frombuffer(e, np.uint64) for e in elements], np.array(comp, np.int64)):
                a.append(no[i])
                b.append(no[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = groups.repartition("g", "block").sortWithinPartitions("g", "block", "no")
    return dealt.select("g", "block", "no", "comp", "elements").mapInArrow(run, "a long, b long")


_NODE = "comp long, lo long, hi long, spare long, bits binary"


def _merged(rows: list[tuple]) -> tuple:
    """One node for several (lo, hi, spare, bits)."""
    words = [np.frombuffer(r[3], np.uint64) for r in rows]
    n = max(map(len, words))
    out = widened(words[0], n).copy()
    for w in words[1:]:
        out |= widened(w, n)
    return min(r[0] for r in rows), max(r[1] for r in rows), max(r[2] for r in rows), out.tobytes()


def _nodes(sets: DataFrame) -> DataFrame:
    """A node for each component of sets(comp, many, elements): the OR of its sets' bitmaps, first within each task; many: it has several sets."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.binary()) for k in range(5)] + [pa.array([r[5] for r in rows], pa.bool_())], names=["comp", "lo", "hi", "spare", "bits", "many"])

        for batch in batches:
            rows = []
            for comp, many, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = np.frombuffer(e.as_py(), np.uint64)
                bits = bitmap(s, bits_for(len(s)))
                node = (len(s), len(s), len(s) - int(np.bitwise_count(bits).sum()), bits.tobytes())
                if many:
                    held[comp] = _merged([held[comp], node]) if comp in held else node
                else:
                    rows.append((comp, *node, False))
            if len(held) > 2000:
                rows += [(c, *node, True) for c, node in held.items()]
                held = {}
            yield batch_of(rows)
        yield batch_of([(c, *node, True) for c, node in held.items()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for comp, lo, hi, spare, bits in _groups(batches, 1):
            node = (comp[0], *_merged(list(zip(lo, hi, spare, bits))))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if k < 4 else pa.binary()) for k, x in enumerate(node)], names=["comp", "lo", "hi", "spare", "bits"])

    parts = materialize(sets.select("comp", "many", "elements").mapInArrow(leaves, _NODE + ", many boolean"), "jaccard-leaves")
    names = ["comp", "lo", "hi", "spare", "bits"]
    several = parts.where("many").select(names).repartition("comp").sortWithinPartitions("comp").mapInArrow(merge, _NODE)
    return materialize(parts.where("not many").select(names).unionByName(several), "jaccard-nodes")


def _candidates(dealt: DataFrame) -> DataFrame:
    """Pairs of components (a, b) that may hold a link, within blocks(key, p, q, comp, lo, hi, spare, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, comp, lo, hi, spare, bits in _groups(batches, 3):
            if len(comp) < 2:
                continue
            lo, hi, spare, comp = (np.array(x, np.int64) for x in (lo, hi, spare, comp))
            words = [np.frombuffer(b, np.uint64) for b in bits]
            for i, j in near_pairs(lo, hi, spare, words, np.arange(len(comp)), np.lexsort((hi, lo))):
                x, y = comp[i], comp[j]
                keep = x != y
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep])], names=["a", "b"])

    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.select("key", "p", "q", "comp", "lo", "hi", "spare", "bits").mapInArrow(run, "a long, b long")


def set_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_elements: int = BLOCK_ELEMENTS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sets, links): rows(doc_id, h, n, fp), the sets that met others as (fp, no), and links (a, b) over `no` that connect what all pairs would.

    Links join any two sets a and b with 100 * |a & b| >= 80 * |a | b|; of the links within what is connected already
    only some are given. Equal sets are one.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    known = materialize(_sets(rows), "jaccard-sets")
    shared = materialize(_met(known), "jaccard-shared")
    n = F.floor(F.col("m") / 4)
    enough = shared.groupBy("doc", n.alias("n")).agg(F.count_distinct("key").alias("k")).where(F.col("k") >= _least_shared(F.col("n")))
    some = materialize(enough.select("doc").distinct(), "jaccard-some")
    shared = materialize(shared.where("m % 4 < 2").select("key", "doc", (F.col("m") % 4 == 0).alias("first")).distinct().join(some, "doc", "left_semi"), "jaccard-keys")

    # the sets that may link, from their texts; each has a number of its own
    sized = known.where("fp is not null").select("doc_id", "h", "fp", F.xxhash64("fp").alias("doc"))
    picks = sized.join(some, "doc").groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("own"), F.first("doc").alias("doc"))
    picks = materialize(picks.select("fp", "doc", F.col("own.doc_id").alias("own_id"), F.col("own.h").alias("own_h"), F.monotonically_increasing_id().alias("no")), "jaccard-picks")
    chosen = F.broadcast(picks) if picks.count() <= SENT_SETS else picks
    chosen = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            out = []
            for no, doc, fp, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if no not in met:
                    s = shingle_set(t.as_py()).tobytes()
                    if xxhash.xxh3_128_digest(s) == fp:
                        met.add(no)
                        out.append((no, doc, len(s) // 8, s))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k < 3 else pa.binary()) for k in range(4)], names=["no", "doc", "n", "elements"])

    sets = materialize(chosen.select("no", "doc", "fp", "text").mapInArrow(elements, "no long, doc long, n long, elements binary"), "jaccard-elements")
    slim = sets.select("no", "doc", "n")

    # most copies link by their first keys: each block of a group with its own sets and one that all blocks have
    early = shared.where("first").select("key", "doc").distinct().join(slim, "doc")
    sizes = early.groupBy("key").agg(F.sum("n").alias("elements"), F.count("*").alias("k"), F.min("no").alias("pivot")).where("k > 1")
    parts = F.greatest(F.ceil(F.col("elements") / block_elements), F.ceil(F.col("k") / BLOCK_SETS)).cast("int")
    sizes = sizes.select("key", "pivot", parts.alias("parts"))
    early = early.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int"))
    early = early.select("key", "block", "no").unionByName(early.where("no = pivot and parts > 1").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), "no")).distinct()
    links = materialize(_exact(early.join(sets, "no").select(F.col("key").alias("g"), "block", "no", F.col("no").alias("comp"), "elements")), "jaccard-links")

    # then components, as nodes, meet by all keys
    joined = connected_components(links)
    member = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    member = materialize(member, "jaccard-members")
    placed = sets.join(member, sets["no"] == member["node"], "left")
    placed = placed.select("no", "doc", "n", F.coalesce("root", "no").alias("comp"), F.col("root").isNotNull().alias("many"), "elements")
    nodes = _nodes(placed)
    where = shared.select("key", "doc").distinct().join(placed.select("doc", "comp"), "doc").select("key", "comp").distinct()
    where = materialize(where, "jaccard-where")
    kinds = where.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("comp")).alias("sig1"), F.bit_xor(F.xxhash64(F.lit(9), "comp")).alias("sig2")).where("k > 1")
    one = kinds.groupBy("k", "sig1", "sig2").agg(F.min("key").alias("key")).select("key")  # keys of the same components are one group
    met = where.join(one, "key").join(nodes, "comp")
    weight = materialize(met.groupBy("key").agg(F.ceil(F.sum(F.octet_length("bits") + 64) / block_bytes).cast("int").alias("parts")), "jaccard-weights")
    own = F.pmod(F.xxhash64("comp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("p"), F.greatest(own, j).alias("q")))
    dealt = met.join(weight, "key").withColumn("b", F.explode(pairs)).select("key", "b.p", "b.q", "comp", "lo", "hi", "spare", "bits")
    near = materialize(_candidates(dealt).distinct(), "jaccard-candidates")

    # and what may link is verified: blocks of the larger component, each with all its partners
    count = placed.groupBy("comp").agg(F.count("*").alias("k"), F.sum("n").alias("elements"))
    count = materialize(count.join(near.select(F.explode(F.array("a", "b")).alias("comp")).distinct(), "comp"), "jaccard-counts")
    side = lambda c: count.select(F.col("comp").alias(c), F.struct("k", F.col("comp").alias("c"), "elements").alias("s_" + c))
    sided = near.join(side("a"), "a").join(side("b"), "b").select(F.greatest("s_a", "s_b").alias("large"), F.least("s_a", "s_b").alias("small"))
    parts = F.greatest(F.ceil(F.col("large.elements") / block_elements), F.ceil(F.col("large.k") / BLOCK_SETS)).cast("int")
    sided = sided.select(F.col("large.c").alias("g"), F.col("small.c").alias("partner"), parts.alias("parts"))
    heads = sided.select("g", F.col("g").alias("comp"), "parts").distinct().join(placed, "comp").withColumn("block", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int"))
    partners = sided.join(placed.withColumnRenamed("comp", "partner"), "partner").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumnRenamed("partner", "comp")
    names = ["g", "block", "no", "comp", "elements"]
    more = materialize(_exact(heads.select(*names).unionByName(partners.select(*names))), "jaccard-links")
    return known, picks.select("fp", "no"), links.unionByName(more)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_elements: int = BLOCK_ELEMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    A set is a text's distinct shingles of five words (ASCII letters in lower case), of the whole sequence where there
    are fewer words. Two rows link when 100 * overlap >= 80 * union; component_id is the smallest doc_id reachable,
    the row's own included. Texts without a word, null ones too, have an empty set and link with nothing. Null ids are
    never the smallest; rows that repeat link like any others; an empty table gives no rows; very long texts are taken
    whole; other columns are ignored.
    """
    known, numbers, links = set_links(docs, id_col, text_col, block_elements, block_bytes)
    roots = connected_components(links)
    classes = known.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("low"))
    classes = classes.join(numbers, "fp", "left").join(roots.withColumnRenamed("node", "no"), "no", "left").select("fp", "low", F.coalesce("root", "no").alias("root"))
    classes = materialize(classes, "jaccard-classes")
    lowest = classes.where("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    classes = classes.join(lowest, "root", "left").select("fp", F.coalesce("least", "low").alias("component_id"))
    return known.join(classes, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
