"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks for each shard, then seeded blocks within it."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, materialize, word_count

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
CAP = 2
#: Words of a block; a source's taken words differ from its target by about this much at most.
BLOCK_WORDS = 32
#: Shards of the mix, each with quotas of its own.
SHARDS = 8
SEED = 20240
#: Documents that one task puts in order within a source, and the least number of hash ranges of a source.
PIECE_ROWS, MIN_PIECES = 20_000, 256


def targets(sizes: list[int], weights: list[int], total: Fraction, cap: int = CAP) -> list[Fraction]:
    """total shared by weight, none above cap times its size; the excess is reshared by weight until none is above."""
    out = [Fraction(0)] * len(sizes)
    open_ = list(range(len(sizes)))
    rest = Fraction(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] > cap * sizes[i] * w]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / w
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
        rest -= sum(out[i] for i in over)
        capped = set(over)
        open_ = [i for i in open_ if i not in capped]
    return out


def sainte_lague(votes: list[Fraction], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2k + 1), none above its cap; ties go to the earlier one.

    A divisor d gives each round(votes / d) seats, which are those of the highest quotients for some number of seats.
    A d near the wanted number is found in floating point; from its exact seats on, quotients in a heap say what is
    given or taken back one by one, at most about half a seat for each source. The cost does not grow with the seats.
    """
    seats = min(seats, sum(c for c, v in zip(caps, votes) if v > 0))
    if seats <= 0:
        return [0] * len(votes)
    unit = math.lcm(*(v.denominator for v in votes))
    whole = [v.numerator * (unit // v.denominator) for v in votes]
    scale = max(whole)
    shares, most = np.array([v / scale for v in whole]), np.array(caps, float)
    filled = lambda d: float(np.minimum(most, np.floor(shares / d + 0.5)).sum())
    low, high = 1.0, 2.1  # a divisor above twice the largest share gives no seats
    while filled(low) < seats:
        low /= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if filled(mid) > seats else (low, mid)
    p, q = (Fraction(high) * scale).as_integer_ratio()
    out = [min(c, (2 * v * q + p) // (2 * p)) for v, c in zip(whole, caps)]
    missing = seats - sum(out)
    if missing > 0:
        heap = [(Fraction(-v, 2 * n + 1), i) for i, (v, n, c) in enumerate(zip(whole, out, caps)) if v > 0 and n < c]
        heapq.heapify(heap)
        for _ in range(missing):
            _, i = heapq.heappop(heap)
            out[i] += 1
            if out[i] < caps[i]:
                heapq.heappush(heap, (Fraction(-whole[i], 2 * out[i] + 1), i))
    elif missing < 0:
        heap = [(Fraction(v, 2 * n - 1), -i) for i, (v, n) in enumerate(zip(whole, out)) if n > 0]
        heapq.heapify(heap)
        for _ in range(-missing):
            i = -heapq.heappop(heap)[1]
            out[i] -= 1
            if out[i]:
                heapq.heappush(heap, (Fraction(whole[i], 2 * out[i] - 1), -i))
    return out


def shard_edges(blocks: int, shards: int) -> list[int]:
    """The first block of each shard, and the number of blocks last: runs of blocks as even as can be."""
    return [blocks * k // shards for k in range(shards + 1)]


def _within(quotas: list[int], room: list[int]) -> list[int]:
    """The quotas with none above its shard's room; what is above goes to the nearest later shard with room, else to earlier ones."""
    out, over = [], 0
    for q, r in zip(quotas, room):
        take = min(q + over, r)
        over += q - take
        out.append(take)
    for k in range(len(out) - 1, -1, -1):
        take = min(over, room[k] - out[k])
        out[k] += take
        over -= take
    return out


def plan_mix(sources: list[tuple[str | None, int]], block: int = BLOCK_WORDS, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE) -> list[dict]:
    """For each source, nulls last and else by code point: size, target, blocks taken in all and in each shard.

    A source's words, in seeded order, are cut into blocks, and runs of blocks are its part of each shard. A shard's
    quotas are the differences of two apportionments, of the blocks up to its end and up to its start; the method
    never takes a block back as the number grows, so they are never negative, and rounding does not add up over
    shards. A quota is at most twice the blocks of its source in the shard; what rounding puts above goes to a neighbour.
    """
    sources = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    sizes = [s[1] for s in sources]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes))
    seats = int(sum(goal) / block + Fraction(1, 2))
    caps = [-(-CAP * s // block) for s in sizes]
    steps = [sainte_lague(goal, seats * k // shards, caps) for k in range(shards + 1)]
    out = []
    for i, (name, size) in enumerate(sources):
        edges = shard_edges(-(-size // block), shards)
        room = [CAP * (b - a) for a, b in zip(edges, edges[1:])]
        quotas = _within([b[i] - a[i] for a, b in zip(steps, steps[1:])], room)
        out.append({"source": name, "source_size": size, "target": float(goal[i]), "blocks": sum(quotas), "shard_blocks": quotas})
    return out


def placed_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, block: int, shards: int, keep: bool = False) -> DataFrame:
    """Each row with its place [lo, hi) among its source's words in seeded order, and the runs of words that the mix takes of it.

    `runs` is an array of (times, from, n): n of the row's words, from its word `from` on, taken so many times. Places are sums over the earlier hash ranges of the source, from
    a table of sums, plus a running sum within the range, so that no task holds a source. keep: with the whole
    input row as the struct `row`.
    """
    text, source = F.col(text_col), F.col(source_col).cast("string")
    own = [
        F.col(id_col).alias("id"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.coalesce(text, F.lit("")).cast("binary"))).alias("h"),
        F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("src"),
    ]
    rows = materialize(docs.select(*own), "mix-rows")
    per = rows.groupBy("src").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()  # one row for each source
    plan = plan_mix([(None if r.src.none else r.src.name, r.words) for r in per], block, shards)
    pieces = max(MIN_PIECES, -(-max((r.n for r in per), default=0) // PIECE_ROWS))
    table = docs.sparkSession.createDataFrame(
        [((p["source"] is None, p["source"] or ""), p["source_size"], p["target"], _shard_rows(p, block, shards, seed)) for p in plan],
        "src struct<none: boolean, name: string>, source_size long, target double, parts array<struct<lo: long, hi: long, rounds: long, rest: long, first: long>>",
    )
    piece = F.pmod(F.shiftrightunsigned("h", 20), F.lit(pieces)).cast("int").alias("piece")
    rows = rows.select("*", piece)
    sums = rows.groupBy("src", "piece").agg(F.sum("size").alias("own"))
    before = sums.select("src", "piece", (F.sum("own").over(Window.partitionBy("src").orderBy("piece")) - F.col("own")).alias("before"))
    before = before.join(table, "src")
    within = Window.partitionBy("src", "piece").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    if keep:  # sizes are counted again, so that no text is written
        rows = docs.select(F.struct(*docs.columns).alias("row"), *own).select("*", piece)
    placed = rows.withColumn("run", F.sum("size").over(within)).join(before, ["src", "piece"])
    placed = placed.withColumns({"lo": F.col("before") + F.col("run") - F.col("size"), "hi": F.col("before") + F.col("run")})
    return placed.withColumn("runs", F.flatten(F.transform("parts", _runs_of)))


def _shard_rows(plan: dict, block: int, shards: int, seed: int) -> list[tuple[int, int, int, int, int]]:
    """(lo, hi, rounds, rest, first) of each shard: its words of the source, how often all are taken, and how many once more, from the seeded block at first on and round."""
    size, edges = plan["source_size"], shard_edges(-(-plan["source_size"] // block), shards)
    out = []
    for k, quota in enumerate(plan["shard_blocks"]):
        lo, hi = min(size, edges[k] * block), min(size, edges[k + 1] * block)
        if hi > lo:
            words = min(quota * block, CAP * (hi - lo))
            start = xxhash.xxh64_intdigest(f"{k}|{plan['source'] is None}|{plan['source'] or ''}", seed) % (edges[k + 1] - edges[k])
            out.append((lo, hi, words // (hi - lo), words % (hi - lo), lo + start * block))
    return out


def _runs_of(p: Column) -> Column:
    """The row's words [lo, hi) in a shard p: taken whole in each round, and its part of the run from p.first on, which goes round at the shard's end."""
    lo, hi = F.greatest(F.col("lo"), p["lo"]), F.least(F.col("hi"), p["hi"])
    struct = lambda times, a, b: F.struct(times.cast("int").alias("times"), (a - F.col("lo")).cast("int").alias("from"), (b - a).cast("int").alias("n"))
    found = [struct(p["rounds"], lo, hi)]
    for shift in (F.lit(0), p["hi"] - p["lo"]):
        a = F.greatest(lo, p["first"] - shift)
        b = F.least(hi, p["first"] + p["rest"] - shift)
        found.append(struct(F.lit(1), a, b))
    return F.filter(F.array(*found), lambda r: (r["times"] > 0) & (r["n"] > 0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    Sources share 150 % of all words by weights 5, 2, 1 in turn, none above twice its size. Equal-token blocks go to
    sources by Sainte-Lague, with quotas for each shard. Documents stand in seeded order, so each block of a source is
    a random one; within a shard whole rounds of its blocks are taken first, and then as many as its quota asks for
    from a block drawn by seed on and round. They are neighbours in that order, so that few documents are taken in
    part. No document is taken more than twice; a source's taken words differ from its target by a block or so. A null text has
    size 0 and taken 0; a null source is one source, the last; null ids and repeated rows are allowed; an empty table
    gives no rows; other columns are ignored.
    """
    placed = placed_documents(docs, id_col, text_col, source_col, seed, block, shards)
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + r["times"] * r["n"])
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """The mix itself, with the columns of docs: one row for each time a document is taken.

    A document that a shard's blocks cover in part (a few at most in each shard of a source) comes with those words
    only, one space between them, in a row for each run of them. Documents without words are not taken. Null ids,
    texts and sources, repeated rows and an empty table as in mix().
    """
    placed = placed_documents(docs, id_col, text_col, source_col, seed, block, shards, keep=True)
    rows = placed.select("row", "size", F.explode("runs").alias("r"))
    text, r = F.col("row").getField(text_col), F.col("r")
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    cut = F.when(r["n"] == F.col("size"), text).otherwise(F.array_join(F.slice(words, r["from"] + 1, r["n"]), " "))
    rows = rows.select("row", cut.alias("taken_text"), r["times"].alias("times"))
    rows = rows.select("row", "taken_text", F.explode(F.sequence(F.lit(1), "times")))
    return rows.select(*[F.col("taken_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
