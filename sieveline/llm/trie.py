"""Prefix trie of conversations: union-find over the LCP edges of sorted neighbours, deepest first.

Conversations are sorted by their turns; each merge of two components at their common depth makes a branching node.
Tasks hold ranges of the order. What touches a range's ends is contracted to its two spines, and spines of
neighbouring ranges are merged in rounds. Only ends and branching nodes go through this; the chains between them are
filled in by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Turns of one row: longer conversations are rows of so many, whose shared ones are folded band by band, deepest first.
BAND_TURNS = 1024
#: Conversations that one task folds, and contracted ranges that one task merges.
TASK_ITEMS, MERGE_RANGES = 20_000, 64
#: Bytes of decimal ids in one row of a list that is hashed.
CHUNK_BYTES = 64 << 10
KEY_BYTES = 16

_RECORD = "depth int, at long, n long, low long, kids long, leaves long, below long, ending long, marks array<string>"
_OUT = f"kind int, part int, seq int, lcp int, lcp_at long, {_RECORD}, parent_depth int, parent_low long, mark string, g binary, keys binary, cum array<long>, start int, start_at long"
_NAMES = [f.split()[0] for f in _OUT.split(", ")]
NODE, ITEM, MARK, TOP, EDGE = range(5)


class Component:
    """A node and all below it: members n, the smallest `low`, what its children sum to, and the conversation that ends at it."""

    __slots__ = ("depth", "at", "n", "low", "kids", "leaves", "below", "ending", "marks", "pending")

    def __init__(self, depth, at, n=0, low=None, kids=0, leaves=0, below=0, ending=None, marks=()):
        self.depth, self.at, self.n, self.low, self.kids, self.leaves, self.below, self.ending = depth, at, n, low, kids, leaves, below, ending
        self.marks, self.pending = list(marks), []

    def record(self) -> dict:
        return {k: getattr(self, k) for k in ("depth", "at", "n", "low", "kids", "leaves", "below", "ending", "marks")}

    def add(self, other: Component) -> None:
        """Another part of the same node."""
        self.n += other.n
        self.low = other.low if self.low is None else self.low if other.low is None else min(self.low, other.low)
        self.kids += other.kids
        self.leaves += other.leaves
        self.below += other.below
        self.ending = other.ending if self.ending is None else self.ending
        self.marks += other.marks
        self.pending += other.pending


def fold(items: list[Component], lcps: list[tuple[int, int]], tag: str, final: bool) -> tuple[list[dict], list[dict]]:
    """Nodes (and marks and tops) that are known, and the contracted items; lcps[i]: depth and bytes that item i shares with the one before, -1 for another group.

    final: nothing comes before or after, so each group's last component is its top.
    """
    out: list[dict] = []
    spines: tuple[list, list] = ([], [])
    n = len(items)
    parent, comp = list(range(n)), items
    sides = [0] * n  # bit 0: holds the first item, bit 1: the last
    if not final:
        sides[0] |= 1
        sides[-1] |= 2
    counter = 0

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def settle(c: Component, **by) -> None:
        """What waits for this node's smallest member, or for its mark, is given."""
        out.extend(p | by for p in c.pending)
        c.pending = []

    def close(c: Component) -> None:
        settle(c, parent_low=c.low)
        out.extend({"kind": MARK, "mark": m, "parent_low": c.low} for m in c.marks)
        c.marks = []

    def flush(c: Component, side: int) -> None:
        nonlocal counter
        if c.n:
            if c.pending:
                counter += 1
                c.marks.append(mark := f"{tag}.{counter}")
                settle(c, mark=mark)
            spines[side].append(c)

    def lift(i: int, depth: int, at: int) -> None:
        c = comp[i]
        if c.depth == depth:
            return
        if sides[i]:
            flush(c, sides[i] >> 1)
            comp[i] = Component(depth, at)
            return
        close(c)
        up = comp[i] = Component(depth, at, c.n, c.low, 1, c.leaves if c.kids else 1, c.below + (c.n - 1) * (c.at - at))
        up.pending.append({"kind": NODE, "parent_depth": depth} | c.record())

    for i in sorted(range(1, n), key=lambda i: -lcps[i][0]):
        depth, at = lcps[i]
        if depth < 0:
            break
        a, b = find(i - 1), find(i)
        lift(a, depth, at)
        lift(b, depth, at)
        comp[a].add(comp[b])
        parent[b] = a
        sides[a] |= sides[b]
        comp[b] = None
    middle, joint = [], (-1, 0)
    for i in range(n):
        if parent[i] != i:
            continue
        c = comp[i]
        if sides[i] == 3:
            joint = (c.depth, c.at)
            if c.n:
                if c.pending:
                    counter += 1
                    c.marks.append(mark := f"{tag}.{counter}")
                    settle(c, mark=mark)
                middle.append(c)
        elif sides[i]:
            flush(c, sides[i] >> 1)
        else:
            close(c)
            out.append({"kind": TOP} | c.record())
    left, right = spines
    contracted = []
    for k, c in enumerate(left + middle):
        contracted.append({"kind": ITEM, "lcp": c.depth if k else lcps[0][0], "lcp_at": c.at if k else lcps[0][1]} | c.record())
    for k in range(len(right) - 1, -1, -1):
        c, up = right[k], right[k + 1] if k + 1 < len(right) else None
        contracted.append({"kind": ITEM, "lcp": up.depth if up else joint[0], "lcp_at": up.at if up else joint[1]} | c.record())
    return out, [r | {"seq": k} for k, r in enumerate(contracted)]


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // KEY_BYTES
    x, y = (np.frombuffer(v, np.uint8, n * KEY_BYTES).reshape(n, KEY_BYTES) for v in (a, b))
    unlike = np.flatnonzero((x != y).any(1))
    return int(unlike[0]) if len(unlike) else n


def _rows(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in kinds], schema=kinds)


def _arrow_schema() -> pa.Schema:
    of = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.split()[0], of[f.split()[1]]) for f in _OUT.split(", ")])


def _components(table: dict[str, list]) -> list[Component]:
    names = ("depth", "at", "n", "low", "kids", "leaves", "below", "ending", "marks")
    return [Component(*v[:8], v[8] or ()) for v in zip(*(table[k] for k in names))]


def _own_ranges(level: int, final: bool):
    """Folds a range of sorted items; also gives its first and last item's keys, for the edge to the next range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, part = _arrow_schema(), TaskContext.get().partitionId()
        items: list[Component] = []
        lcps: list[tuple[int, int]] = []
        groups: list[bytes] = []
        first = last = None
        for batch in batches:
            t = batch.to_pydict()
            items += _components(t)
            for row in zip(t["g"], t["keys"], t["cum"], t["start"], t["start_at"]):
                g, keys, cum, start, start_at = row
                if last is None or last[0] != g:
                    lcps.append((-1, 0))
                else:
                    k = shared_turns(last[1], keys)
                    lcps.append((start + k, cum[k - 1] if k else start_at))
                groups.append(g)
                last = row
                first = first or row
        if not items:
            return
        out, contracted = fold(items, lcps, f"{level}.0.{part}", final)
        if not final:
            names = ("g", "keys", "cum", "start", "start_at")
            out += [{"kind": EDGE, "seq": k} | dict(zip(names, row)) for k, row in enumerate((first, last))]
        out += contracted
        for k in range(0, len(out), 10_000):
            yield _rows([r | {"part": part} for r in out[k : k + 10_000]], kinds)

    return run


def _merged_ranges(level: int, turn: int, edges: dict[int, tuple[int, int]], final: bool):
    """Folds the contracted items of neighbouring ranges; edges: what each range's first item shares with the range before."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
        t = table.to_pydict()
        lcps = [edges[p] if s == 0 else (x, y) for p, s, x, y in zip(t["part"], t["seq"], t["lcp"], t["lcp_at"])]
        # `part` is the first range that a merged run of ranges begins with, so edges stay good for the next turn
        part = t["part"][0]
        out, contracted = fold(_components(t), lcps, f"{level}.{turn}.{part}", final)
        return pa.Table.from_batches([_rows([r | {"part": part} for r in out + contracted], _arrow_schema())])

    return run


def _edge_depths(found: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range that has rows: depth and bytes that its first item shares with the last item of the range before."""
    ends = found.where(F.col("kind") == EDGE).select("part", "seq", "g", "keys", "cum", "start", "start_at")
    parts = sorted(r.part for r in ends.where("seq = 0").select("part").collect())  # a number for each range
    spark = found.sparkSession
    pairs = spark.createDataFrame(list(zip(parts[1:], parts)) or [(-1, -1)], "part int, before int")
    last = ends.where("seq = 1").select(F.col("part").alias("before"), F.col("g").alias("last_g"), F.col("keys").alias("last_keys"))
    met = ends.where("seq = 0").join(pairs, "part").join(last, "before").select("part", "g", "keys", "cum", "start", "start_at", "last_g", "last_keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                same = r["g"] == r["last_g"]
                k = shared_turns(r["keys"], r["last_keys"]) if same else 0
                rows.append((r["part"], r["start"] + k if same else -1, r["cum"][k - 1] if k else r["start_at"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["part", "lcp", "at"])

    got = {r.part: (r.lcp, r.at) for r in met.mapInArrow(run, "part int, lcp int, at long").collect()}
    return {p: got.get(p, (-1, 0)) for p in parts}


def _fold_level(items: DataFrame, level: int, task_items: int, merge_ranges: int) -> DataFrame:
    """NODE, MARK and TOP rows of one band's items(g, keys, cum, start, start_at, and a component), which are unlike within a group."""
    parts = max(1, -(-items.count() // task_items))
    ranged = items.repartitionByRange(parts, "g", "keys").sortWithinPartitions("g", "keys")
    parts = ranged.rdd.getNumPartitions() if parts == 1 else parts
    found = materialize(ranged.mapInArrow(_own_ranges(level, parts == 1), _OUT), "trie-ranges")
    done = [found.where(F.col("kind").isin(NODE, MARK, TOP))]
    if parts > 1:
        edges = _edge_depths(found)
        order = {p: k for k, p in enumerate(sorted(edges))}
        turn, width = 0, 1
        spark = items.sparkSession
        while True:
            turn, width = turn + 1, width * merge_ranges
            final = width >= len(order)
            run = spark.createDataFrame([(p, k // width) for p, k in order.items()] or [(-1, 0)], "part int, run int")  # a number for each range
            own = found.where(F.col("kind") == ITEM).join(F.broadcast(run), "part").groupBy("run")
            found = materialize(own.applyInArrow(_merged_ranges(level, turn, edges, final), _OUT), "trie-merged")
            done.append(found.where(F.col("kind").isin(NODE, MARK, TOP)))
            if final:
                break
    return reduce(DataFrame.unionByName, done)


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, key, bytes) of rows(conv_id, turn, role, text): the place of each turn in its conversation, from 1.

    Rows are range-partitioned by conversation and turn, so a long conversation lies in many tasks; each counts its
    own rows and a few numbers a task tell how many came before.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    hashed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"), role.alias("role"), F.monotonically_increasing_id().alias("nth")).where("conv_id is not null")
    hashed = materialize(hashed, "trie-turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("nth")]
    parts = max(2, -(-hashed.count() // 500_000))
    ranged = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "key", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            c = batch.column(0).to_numpy()
            if not len(c):
                continue
            fresh = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            base = np.repeat(fresh, np.diff(np.append(fresh, len(c))))
            local = np.arange(1, len(c) + 1) - base
            if c[0] == conv:
                local[: fresh[1] if len(fresh) > 1 else len(c)] += seen
            conv, seen = c[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), batch.column(0), pa.array(local.astype(np.int64)), batch.column(1), batch.column(2)], names=["part", "conv_id", "local", "key", "bytes"])

    counted = materialize(ranged.mapInArrow(run, "part int, conv_id long, local long, key binary, bytes long"), "trie-counted")
    last = F.max(F.struct("conv_id", "local"))
    ends = sorted(tuple(r) for r in counted.groupBy("part").agg(F.min("conv_id").alias("first"), last.alias("last")).select("part", "first", "last.*").collect())
    before, offsets = (None, 0), []
    for part, first, conv, local in ends:
        offsets.append((part, first, before[1] if before[0] == first else 0))
        before = (conv, local + (offsets[-1][2] if first == conv else 0))
    offsets = rows.sparkSession.createDataFrame(offsets or [(-1, 0, 0)], "part int, first long, more long")  # a row for each task
    pos = F.col("local") + F.when(F.col("conv_id") == F.col("first"), F.col("more")).otherwise(0)
    return counted.join(F.broadcast(offsets), "part").select("conv_id", pos.alias("pos"), "key", "bytes")


def rebuilt_turns(turns: DataFrame, family: int = 5, shares: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, bytes) of conversations that begin as the first of their family does, and the ids of all.

    Of `family` ids in a row the first gives the beginning: its first h turns, with h = crc32(decimal id) % shares of
    the conversation; the conversation's own turns follow after its first h.
    """
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    h = (F.crc32(c.cast("string").cast("binary")) % shares).cast("long")
    convs = convs.select("conv_id", "own", (c - F.pmod(c, F.lit(family))).alias("base"), h.alias("h"))
    bases = convs.where("conv_id = base").select("base", F.col("own").alias("base_own"))
    convs = materialize(convs.join(bases, "base", "left").withColumn("begun", F.least("h", F.coalesce("base_own", F.lit(0)))), "trie-convs")
    heads = turns.where((F.pmod(c, F.lit(family)) == 0) & (F.col("pos") < shares)).withColumnRenamed("conv_id", "base")
    begun = convs.select("conv_id", "base", "begun").join(heads, "base").where("pos <= begun").select("conv_id", "pos", "key", "bytes")
    own = turns.where(F.col("pos") > h).join(convs.select("conv_id", "h", "begun"), "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("begun")).alias("pos"), "key", "bytes")
    return begun.unionByName(own), convs.select("conv_id")


def list_hashes(members: DataFrame) -> DataFrame:
    """(rep, sha): SHA-256 of the decimal ids of each rep's members(rep, conv_id), ascending, with commas between.

    A hash over a list is one stream; before it, tasks pack the sorted ids into rows of CHUNK_BYTES, so the one that
    hashes a large list reads a row for each 10,000 ids and holds one at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, str]]:
            rep, ids, size = None, [], 0
            for batch in batches:
                for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if ids and (r != rep or size > CHUNK_BYTES):
                        yield rep, ids[0], ",".join(map(str, ids))
                        ids, size = [], 0
                    rep = r
                    ids.append(c)
                    size += 12
            if ids:
                yield rep, ids[0], ",".join(map(str, ids))

        for row in rows():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.string()))], names=["rep", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, h, reps, shas = None, None, [], []
        for batch in batches:
            for r, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != rep or h is None:
                    if h is not None:
                        reps.append(rep)
                        shas.append(h.hexdigest())
                    rep, h = r, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.as_py().encode())
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas)], names=["rep", "sha"])
                reps, shas = [], []
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([h.hexdigest()])], names=["rep", "sha"])

    parts = max(2, -(-members.count() // 500_000))
    packed = members.repartitionByRange(parts, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(pack, "rep long, first long, ids string")
    return packed.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(digest, "rep long, sha string")


def prefix_nodes(turns: DataFrame, convs: DataFrame, band: int = BAND_TURNS, task_items: int = TASK_ITEMS, merge_ranges: int = MERGE_RANGES) -> DataFrame:
    """The nodes of the trie of turns(conv_id, pos, key, bytes), with convs(conv_id) the ids of all, turnless ones too.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each
    distinct beginning of a conversation, by turns' keys of 16 bytes: its smallest member; the members; childless nodes
    below or at it; (n_convs - 1) times the bytes of the last turn, summed over it and all below; the hash of the ids that
    end at it. Equal conversations are folded once. No conversations give no rows.
    """
    spark = turns.sparkSession
    d = F.col("pos")
    at_band = F.floor((d - 1) / band).cast("int").alias("band")
    mix = [F.xxhash64(F.lit(s), "pos", "key") for s in (1, 2)]
    cells = turns.select("conv_id", at_band, "pos", "key", "bytes", mix[0].alias("x1"), mix[1].alias("x2"))
    t = F.sort_array(F.collect_list(F.struct("pos", "key", "bytes")))
    rows = cells.repartition("conv_id", "band").groupBy("conv_id", "band").agg(t.alias("t"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("bytes").alias("size"), F.count("*").cast("int").alias("turns"))
    keys = F.unhex(F.array_join(F.transform("t", lambda c: F.hex(c["key"])), ""))
    sums = F.aggregate("t", F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("all")), lambda a, c: F.struct((a["s"] + c["bytes"]).alias("s"), F.concat(a["all"], F.array(a["s"] + c["bytes"])).alias("all")), lambda a: a["all"])
    rows = materialize(rows.select("conv_id", "band", keys.alias("keys"), sums.alias("cum"), "x1", "x2", "size", "turns"), "trie-bands")

    # whole conversations, and what is equal among them
    whole = rows.groupBy("conv_id").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("turns").cast("int").alias("len"), F.sum("size").alias("size"))
    whole = convs.join(whole, "conv_id", "left").na.fill(0, ["x1", "x2", "len", "size"])
    whole = materialize(whole, "trie-whole")
    classes = materialize(whole.groupBy("x1", "x2", "len").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.min("size").alias("size")), "trie-classes")
    if not classes.take(1):
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    many = whole.join(classes.where("n > 1").select("x1", "x2", "len", "rep"), ["x1", "x2", "len"]).select("rep", "conv_id")
    alone = classes.where("n = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("sha"))
    ends = list_hashes(many).unionByName(alone)

    # each band's start: the hash and bytes of all turns before; bands that begin where a conversation ends are empty
    first = rows.where("band = 0").withColumns({"g1": F.lit(0).cast("long"), "g2": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    slim = rows.select("conv_id", "band", "x1", "x2", "size").join(rows.where("band > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    w = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.select("conv_id", "band", F.bit_xor("x1").over(w).alias("g1"), F.bit_xor("x2").over(w).alias("g2"), F.sum("size").over(w).alias("before")).where("band > 0")
    later = rows.where("band > 0").join(starts, ["conv_id", "band"]).withColumn("cum", F.transform("cum", lambda s: s + F.col("before")))
    empty = classes.where(F.col("len") % band == 0).select(F.col("rep").alias("conv_id"), F.floor(F.col("len") / band).cast("int").alias("band"), F.lit(b"").alias("keys"), F.array().cast("array<long>").alias("cum"), F.col("x1").alias("g1"), F.col("x2").alias("g2"), F.col("size").alias("before"))
    names = ["conv_id", "band", "keys", "cum", "g1", "g2", "before"]
    bands = materialize(first.select(*names).unionByName(later.select(*names)).unionByName(empty), "trie-starts")

    # the deepest band that a class shares the beginning of with another: there it is an item of its own
    reps = classes.select("rep", "n", "len", "size")
    starts = bands.where("band > 0").join(reps.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").select("conv_id", "band", "g1", "g2")
    shared = starts.groupBy("band", "g1", "g2").agg(F.count("*").alias("k")).where("k > 1")
    own = starts.join(shared, ["band", "g1", "g2"]).groupBy(F.col("conv_id").alias("rep")).agg(F.max("band").alias("band"))
    reps = materialize(reps.join(own, "rep", "left").na.fill(0, ["band"]), "trie-reps")
    group = F.concat(F.unhex(F.lpad(F.hex("g1"), 16, "0")), F.unhex(F.lpad(F.hex("g2"), 16, "0")))
    placed = bands.select(F.col("conv_id").alias("low"), "band", group.alias("g"), "keys", "cum", (F.col("band") * band).cast("int").alias("start"), F.col("before").alias("start_at"))
    zero = F.lit(0).cast("long")
    items = reps.select(F.col("rep").alias("low"), "band", F.col("len").alias("depth"), F.col("size").alias("at"), "n", zero.alias("kids"), zero.alias("leaves"), zero.alias("below"), F.col("rep").alias("ending"), F.array().cast("array<string>").alias("marks"))
    columns = [f.split()[0] for f in _RECORD.split(", ")]
    found, tops = [], None
    deepest = reps.agg(F.max("band")).first()[0] or 0
    for level in range(deepest, -1, -1):
        here = items.where(F.col("band") == level)
        if tops is not None:
            here = here.unionByName(tops.withColumn("band", F.lit(level)).select("low", "band", *[c for c in columns if c != "low"]))
        here = here.join(placed, ["low", "band"]).select("g", "keys", "cum", "start", "start_at", *columns)
        got = _fold_level(here, level, task_items, merge_ranges)
        found.append(got)
        tops = got.where(F.col("kind") == TOP).select(*columns)
    return _filled(reduce(DataFrame.unionByName, found), tops, placed, ends, band)


def _filled(found: DataFrame, top: DataFrame, placed: DataFrame, ends: DataFrame, band: int) -> DataFrame:
    """All nodes from those that branch or end something: the chain above such a node has its members, and one child a node."""
    low = F.col("low")
    marks = found.where(F.col("kind") == MARK).select("mark", F.col("parent_low").alias("given"))
    columns = ["low", "n", "depth", "at", "kids", "leaves", "below", "ending", "parent_depth", "parent_low"]
    nodes = found.where(F.col("kind") == NODE)
    waiting = nodes.where("mark is not null").join(marks, "mark").withColumn("parent_low", F.col("given"))
    leaves = F.when(F.col("kids") > 0, F.col("leaves")).otherwise(1)
    # the last component, and the root above it where all conversations begin alike
    under = top.where("depth > 0").withColumns({"parent_depth": F.lit(0), "parent_low": low})
    root = top.where("depth = 0").select(low, "n", "kids", leaves.alias("leaves"), "below", "ending").unionByName(
        top.where("depth > 0").select(low, "n", F.lit(1).cast("long").alias("kids"), leaves.alias("leaves"), (F.col("below") + (F.col("n") - 1) * F.col("at")).alias("below"), F.lit(None).cast("long").alias("ending"))
    )
    nodes = nodes.where("mark is null").select(*columns).unionByName(waiting.select(*columns)).unionByName(under.select(*columns))
    none = F.sha2(F.lit(b""), 256)
    ends = ends.withColumnRenamed("rep", "ending")
    root = root.join(ends, "ending", "left").select(
        low.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("below").alias("saved_tokens"), F.coalesce("sha", none).alias("ends_sha256")
    )
    nodes = nodes.join(ends, "ending", "left").withColumn("band", F.explode(F.sequence(F.floor(F.col("parent_depth") / band).cast("int"), F.floor((F.col("depth") - 1) / band).cast("int"))))
    nodes = nodes.join(placed.select("low", "band", "cum", "start", "start_at"), ["low", "band"])
    chain = F.sequence(F.greatest(F.col("parent_depth"), F.col("start")) + 1, F.least(F.col("depth"), F.col("start") + band))
    before = F.transform(chain, lambda d: F.struct(d.alias("d"), F.when(d - 1 > F.col("start"), F.get("cum", d - F.col("start") - 2)).otherwise(F.col("start_at")).alias("before")))
    nodes = nodes.withColumn("c", F.explode(before))
    d, last = F.col("c.d"), F.col("c.d") == F.col("depth")
    nodes = nodes.select(
        low.alias("conv_id"),
        d.cast("long").alias("depth"),
        F.when(d == F.col("parent_depth") + 1, F.col("parent_low")).otherwise(low).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(1).alias("n_children"),
        leaves.alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("at") - F.col("c.before"))).alias("saved_tokens"),
        F.when(last, F.coalesce("sha", none)).otherwise(none).alias("ends_sha256"),
    )
    return root.unionByName(nodes)


def conversation_trie(conversations: DataFrame, rebuilt: bool = False, band: int = BAND_TURNS, task_items: int = TASK_ITEMS, merge_ranges: int = MERGE_RANGES) -> DataFrame:
    """The prefix trie of conversations(conv_id, turn, role, text), a row for each node; columns as in prefix_nodes().

    Turns are ordered by turn, null first, then by role and by content; a null role or text is an empty one; rows that
    repeat are turns of their own. Rows without a conv_id are of no conversation and left out. rebuilt: conversations
    are first given the beginnings of their families (rebuilt_turns()). Empty and very long texts are keys of 16 bytes
    like any other; an empty table gives no rows; other columns are ignored.
    """
    turns = numbered_turns(conversations.select("conv_id", "turn", "role", "text"))
    turns, convs = rebuilt_turns(turns) if rebuilt else (turns, turns.select("conv_id").distinct())
    return prefix_nodes(turns, convs, band, task_items, merge_ranges)
