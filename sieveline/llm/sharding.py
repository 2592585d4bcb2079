"""Sharding by Karmarkar-Karp differencing of indivisible groups of equal texts, in tasks and then over their states."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialize, utf8

#: A group with over this part of all bytes or of all rows is differenced first, on the driver: twice as many at most.
BIG_PART = 4096
#: Groups that one task differences, about, and states of tasks that the driver (or one task of a further level) does.
PIECE_GROUPS, PIECE_STATES = 32_768, 4096
#: Documents that one task numbers within a shard.
SLOT_ROWS = 20_000


def difference(states: list[tuple[int, ...]]) -> tuple[list[int], list[list[int]]]:
    """(sums, places): all partial partitions joined into one by largest differencing.

    A state is its parts' sums. The two states of the largest spread are combined oppositely ordered, the heaviest
    part of one with the lightest of the other, until one is left. Ties go to the state made first, so reruns agree.
    places[i][k]: the part of the result that part k of state i went to.
    """
    ways = len(states[0])
    # a part's members are a binary tree of nested pairs, so that joining two parts costs O(1); leaves are (state, part)
    heap = []
    for i, sums in enumerate(states):
        order = sorted(range(ways), key=lambda k: -sums[k])
        low = sums[order[-1]]
        # only differences matter
        heap.append((low - sums[order[0]], i, [sums[k] - low for k in order], [i * ways + k for k in order]))
    heapq.heapify(heap)
    made = len(states)
    while len(heap) > 1:
        _, _, a, a_items = heapq.heappop(heap)
        _, _, b, b_items = heapq.heappop(heap)
        joined = sorted(((x + y, k) for k, (x, y) in enumerate(zip(a, reversed(b)))), key=lambda z: -z[0])
        low = joined[-1][0]
        items = [(a_items[k], b_items[ways - 1 - k]) for _, k in joined]
        heapq.heappush(heap, (low - joined[0][0], made, [s - low for s, _ in joined], items))
        made += 1
    places = [[0] * ways for _ in states]
    totals = [0] * ways
    for part, tree in enumerate(heap[0][3]):
        todo = [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                places[x // ways][x % ways] = part
                totals[part] += states[x // ways][x % ways]
    return totals, places


def karmarkar_karp(sizes: list[int], ways: int) -> list[int]:
    """The part of each single item."""
    if not sizes:
        return []
    return [p[0] for p in difference([(s, *[0] * (ways - 1)) for s in sizes])[1]]


def _anchored(states: list[tuple[int, ...]]) -> tuple[list[int], list[list[int]]]:
    """difference(), its parts renamed so that part k of the first state stays part k."""
    totals, places = difference(states)
    name = {part: k for k, part in enumerate(places[0])}
    out = [0] * len(totals)
    for part, k in name.items():
        out[k] = totals[part]
    return out, [[name[p] for p in place] for place in places]


def _solve_piece(key: str, ways: int, seeded: int, seed: list[int]):
    """Differences the states of one piece at a time; rows (piece, key, sums) come in adjacent pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(piece: int, keys: list, states: list) -> pa.RecordBatch:
            states = [tuple(s) + (0,) * (ways - len(s)) for s in states]
            first = [tuple(x // seeded for x in seed)] if piece < seeded else []
            _, places = _anchored(first + states)
            places = places[len(first) :]
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array([piece] * n, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["piece", key, "places"])

        piece, keys, states = None, [], []
        for batch in batches:
            for p, k, s in zip(*(c.to_pylist() for c in batch.columns)):
                if p != piece and keys:
                    yield solve(piece, keys, states)
                    keys, states = [], []
                piece = p
                keys.append(k)
                states.append(s)
        if keys:
            yield solve(piece, keys, states)

    return run


def _in_pieces(items: DataFrame, key: str, ways: int, seeded: int, seed: list[int]) -> DataFrame:
    """(piece, key, places) for items(piece, key, sums), each piece differenced in one task."""
    dealt = items.select("piece", key, "sums").repartition("piece").sortWithinPartitions("piece", F.desc(F.array_max("sums")), key)
    return dealt.mapInArrow(_solve_piece(key, ways, seeded, seed), f"piece long, {key} long, places array<int>")


def _states(placed: DataFrame, ways: int) -> DataFrame:
    """(piece, sums) of the parts of each piece, from rows (piece, sums, places)."""
    cells = F.arrays_zip(F.col("places").alias("p"), F.col("sums").alias("s"))
    sums = [F.sum(F.aggregate(F.filter(cells, lambda c, k=k: c["p"] == k), F.lit(0).cast("long"), lambda t, c: t + c["s"])) for k in range(ways)]
    return placed.groupBy("piece").agg(F.array(*sums).alias("sums"))


def assign_groups(groups: DataFrame, shards: int, big_part: int = BIG_PART, piece_groups: int = PIECE_GROUPS, piece_states: int = PIECE_STATES) -> tuple[DataFrame, DataFrame]:
    """(big, rest), both (h, shard): the shard of each of groups(h, g bytes, n rows), by differencing of all of them.

    Groups with over 1 / big_part of all bytes or rows are differenced on the driver. The others are dealt by hash into
    pieces of about piece_groups, and each task differences its piece into one state. As many pieces as it takes to
    level the big groups' state (twice their bytes, all if need be) start from an equal share of that state and keep
    its parts; their states are then added to it. States of the other pieces are differenced like items, in as many
    levels as it takes until piece_states are left, and those with the big groups' state on the driver.
    """
    spark = groups.sparkSession
    all_ = groups.agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    none = spark.createDataFrame([], "h long, shard int")
    if not all_.groups:
        return none, none
    big = (F.col("g") * big_part > all_.g) | (F.col("n") * big_part > all_.n)
    top = sorted(groups.where(big).collect(), key=lambda r: (-r.g, r.h))
    seed, own = [0] * shards, []
    if top:
        seed, places = difference([(r.g, *[0] * (shards - 1)) for r in top])
        own = [p[0] for p in places]
    bigs = spark.createDataFrame([(r.h, k) for r, k in zip(top, own)], "h long, shard int")
    rest = groups.where(~big)
    n_rest, bytes_rest = all_.groups - len(top), all_.g - sum(r.g for r in top)
    if not n_rest:
        return bigs, none
    pieces = -(-n_rest // piece_groups)
    missing = shards * max(seed) - sum(seed)
    seeded = min(pieces, int(Fraction(2 * missing * pieces, max(1, bytes_rest))) + 1)
    items = rest.select(F.pmod(F.xxhash64("h", F.lit(31)), F.lit(pieces)).alias("piece"), "h", F.array("g").alias("sums"))
    placed = materialize(_in_pieces(items, "h", shards, seeded, seed), "shard-groups-placed")
    states = materialize(_states(placed.join(items.select("h", "sums"), "h"), shards), "shard-states")
    # part k of a seeded piece is part k of the big groups' state
    levelled = states.where(F.col("piece") < seeded).agg(*[F.coalesce(F.sum(F.get("sums", k)), F.lit(0)).alias(f"s{k}") for k in range(shards)]).first()
    base = [a + b for a, b in zip(seed, levelled)]
    levels, free, n_free = [], states.where(F.col("piece") >= seeded), pieces - seeded
    while n_free > piece_states:
        n_free = -(-n_free // piece_states)
        up = free.select(F.pmod(F.xxhash64("piece", F.lit(32)), F.lit(n_free)).alias("up"), F.col("piece").alias("below"), "sums").withColumnRenamed("up", "piece")
        level = materialize(_in_pieces(up, "below", shards, 0, seed), "shard-level")
        levels.append(level)
        free = materialize(_states(level.join(up.select("below", "sums"), "below"), shards), "shard-states")
    last = sorted(free.collect(), key=lambda r: r.piece)  # piece_states at most
    _, places = _anchored([tuple(base)] + [tuple(r.sums) for r in last])
    ends = [(r.piece, p) for r, p in zip(last, places[1:])] + ([] if levels else [(k, list(range(shards))) for k in range(seeded)])
    turn = spark.createDataFrame(ends, "piece long, turn array<int>")
    for level in reversed(levels):  # from a piece to where its parts went, level by level
        turn = level.join(turn, "piece").select(F.col("below").alias("piece"), F.transform("places", lambda p: F.get("turn", p)).alias("turn"))
    if levels:
        turn = turn.unionByName(spark.createDataFrame([(k, list(range(shards))) for k in range(seeded)], "piece long, turn array<int>"))
    shard = F.get("turn", F.get("places", 0))
    return bigs, placed.join(turn, "piece").select("h", shard.alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", big_part: int = BIG_PART, piece_groups: int = PIECE_GROUPS, piece_states: int = PIECE_STATES) -> DataFrame:
    """Every row of docs with size, text_crc32, shard and slot; equal texts share a shard, shards are near equal in bytes.

    Size is the text's UTF-8 bytes plus 1; a null text counts as an empty one. All groups (equal texts, by 64-bit hash)
    go through the differencing of assign_groups(); a group is never split, so one with more than a shard's even share
    has a shard of its own and the others are even among themselves. Slots number each shard's rows from 0 without
    gaps, by hash range and then by id. Nulls in any column, repeated rows and an empty table are allowed; columns
    of docs other than id and text are dropped.
    """
    text = utf8(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = materialize(rows, "shard-rows")  # a few numbers for each row; the texts are read once
    groups = materialize(rows.groupBy("h").agg(F.sum("size").alias("g"), F.count("*").alias("n")), "shard-groups")
    big, rest = assign_groups(groups, shards, big_part, piece_groups, piece_states)
    n_rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a group of many rows is big and meets its shard without a shuffle; what is shuffled by hash has no large group
    big = big.withColumnRenamed("shard", "big_shard")
    known = rows.join(F.broadcast(big), "h", "left")
    placed = known.where("big_shard is not null").withColumnRenamed("big_shard", "shard").unionByName(known.where("big_shard is null").drop("big_shard").join(rest, "h"))
    ranges = max(32, -(-n_rows // SLOT_ROWS))
    # rows without an id are spread by what tells them apart at all, which may be nothing but their place
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", spread, F.lit(7)), F.lit(ranges)).alias("piece"))
    placed = materialize(placed, "shard-placed")
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = counts.select("shard", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("before"))
    within = Window.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(before, ["shard", "piece"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs below path, one folder per shard, and return the assignment. Rows that share an id are placed by id and text."""
    plan = materialize(shard_documents(docs, shards, id_col, text_col), "shard-plan")
    key, crc = free_name(docs, "shard_key"), free_name(docs, "shard_crc")
    own = free_name(docs, "shard_crc_of_row")
    part = free_name(docs, "shard")
    one = plan.groupBy(F.col("doc_id").alias(key), F.col("text_crc32").alias(crc)).agg(F.min("shard").alias(part))
    keyed = docs.withColumn(own, F.crc32(utf8(F.col(text_col))))
    out = keyed.join(one, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(crc))).drop(key, crc, own)
    out.write.partitionBy(part).mode("overwrite").parquet(path)
    return plan
