"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Links that one task takes; with no more than that a round has no shuffle.
TASK_LINKS = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for every node that is not its component's smallest node; root is that smallest node.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at
    most. Rounds go on until the set of edges no longer changes; nothing is collected but a count and a checksum. Few
    links stay in one partition, where grouping and joining them needs no exchange. Self-links and repeated edges are
    allowed; rows with a null end are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e, path = written(e.distinct(), "links")
    state = _state(e)
    while state[0]:
        if state[0] <= task_links:
            e = e.coalesce(1)
        pair = lambda v, m: F.struct(v.alias("v"), m.alias("m"))
        v, m, low = F.col("v"), F.col("m"), F.col("low")
        # large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours
        both = e.select(F.explode(F.array(pair(v, m), pair(m, v))).alias("e")).select("e.v", "e.m")
        lowest = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.where("m > v").join(lowest, "v").select(m.alias("v"), low.alias("m")).distinct()
        # small star: every smaller neighbour of a node, and the node, are linked to the smallest
        lowest = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(lowest, "v").select(F.explode(F.array(pair(m, low), pair(v, low))).alias("e")).select("e.v", "e.m")
        e, done = written(small.where("v != m").distinct(), "links")
        new = _state(e)
        discard(path)  # the round before is read no more
        path = done
        if new == state:
            break
        state = new
    return e.select(F.col("v").alias("node"), F.col("m").alias("root"))
