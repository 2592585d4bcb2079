"""Ranking, calibration and multilabel metrics as aggregations over (group, label, score, ord) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """Rank and hits so far, by falling score; the row order `ord` settles ties."""
    return ranked(df, by, [F.desc("score"), F.asc("ord")], "label")


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean precision at the positives; 0 without positives."""
    at = F.sum(F.when(F.col("label") == 1, F.col("hits") / F.col("rank")))
    return _ranked(df, by).groupBy(*by).agg(F.coalesce(at / F.nullif(F.sum("label"), F.lit(0)), F.lit(0.0)).alias("ap"))


def at_k(df: DataFrame, by: list[str], percents: list[float]) -> DataFrame:
    """(by, percent, k, precision, recall) with k = max(1, round half even of the share of rows)."""
    percents = [float(p) for p in percents]
    totals = df.groupBy(*by).agg(F.count("*").alias("_all"), F.sum("label").alias("_pos"))
    rows = _ranked(df, by)
    rows = rows.join(totals, by) if by else rows.crossJoin(F.broadcast(totals))  # one row of totals
    k = [F.greatest(F.lit(1), F.bround(F.col("_all") * F.lit(p) / 100, 0)).cast("long") for p in percents]
    found = rows.groupBy(*by).agg(F.first("_pos").alias("_pos"), *[F.first(x).alias(f"_k{i}") for i, x in enumerate(k)], *[F.sum(F.when(F.col("rank") <= x, F.col("label")).otherwise(0)).alias(f"_top{i}") for i, x in enumerate(k)])
    cell = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"_k{i}").alias("k"), F.col(f"_top{i}").alias("top")) for i, p in enumerate(percents)]))
    found = found.select(*by, "_pos", cell.alias("c"))
    return found.select(*by, "c.percent", "c.k", (F.col("c.top") / F.col("c.k")).alias("precision"), F.when(F.col("_pos") > 0, F.col("c.top") / F.col("_pos")).otherwise(F.lit(0.0)).alias("recall"))


def _bin(bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")


def calibration_curve(df: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """(by, bin, n, mean_score, positive_rate) of equal-width bins that have rows; 1.0 falls into the last."""
    if bins <= 0:
        raise ValueError("bins must be positive")
    return df.groupBy(*by, _bin(bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("positive_rate"))


def expected_calibration_error(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    cells = calibration_curve(df, by, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("positive_rate"))) / F.sum("n")
    return cells.groupBy(*by).agg(gap.alias("ece")) if by else cells.agg(F.coalesce(gap, F.lit(0.0)).alias("ece"))


def ranking_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap, ece, and precision and recall at 1 and 5 percent) of each group, one row a group."""
    if not by:
        raise ValueError("ranking metrics need a group")
    cut = at_k(df, by, [1.0, 5.0])
    at = lambda p, c: F.max(F.when(F.col("percent") == p, F.col(c)))
    shares = cut.groupBy(*by).agg(at(1.0, "precision").alias("precision_1"), at(5.0, "precision").alias("precision_5"), at(1.0, "recall").alias("recall_1"), at(5.0, "recall").alias("recall_5"))
    return average_precision(df, by).join(expected_calibration_error(df, by), by).join(shares, by)


def best_runs(df: DataFrame, by: list[str], run: str, value: str) -> DataFrame:
    """(by, run): each group's run of the largest value; missing values come last, ties go to the smallest run."""
    return df.groupBy(*by).agg(F.min_by(run, F.struct((-F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")))).alias("v"), F.col(run).alias("r"))).alias(run))


def score_table(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A row for each `row` with its value in each of the named columns; null where it has none, the largest where it has several."""
    return df.groupBy(row).pivot(column, columns).agg(F.max(value))


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg((F.col(label) == F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy"))


def macro_f1(df: DataFrame, label: str, predicted: str, universe: list[str]) -> DataFrame:
    """(tag, tp, fp, fn, f1) for each tag of the universe, from one pass; the mean of f1 is the macro score."""
    cells = F.array(*[F.struct(F.lit(t).alias("tag"), F.array_contains(label, t).alias("y"), F.array_contains(predicted, t).alias("p")) for t in universe])
    got = df.select(F.explode(cells).alias("c")).groupBy("c.tag").agg(
        F.count_if(F.expr("c.y and c.p")).alias("tp"),
        F.count_if(F.expr("not c.y and c.p")).alias("fp"),
        F.count_if(F.expr("c.y and not c.p")).alias("fn"),
    )
    return got.withColumn("f1", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0)))


def provenance_coverage(df: DataFrame, *arrays: str) -> DataFrame:
    full = F.lit(True)
    for a in arrays:
        full = full & (F.size(a) > 0)
    return df.agg(F.coalesce(F.avg(full.cast("double")), F.lit(0.0)).alias("coverage"))


def average_precision_list(labels: list[int], scores: list[float]) -> float:
    """The same for a bounded driver-side sample, as the bootstrap draws need it."""
    if len(labels) != len(scores):
        raise ValueError("labels and scores differ in length")
    hits, total = 0, 0.0
    for rank, i in enumerate(sorted(range(len(scores)), key=lambda k: -scores[k]), 1):
        if labels[i]:
            hits += 1
            total += hits / rank
    return total / hits if hits else 0.0


#: Draws of one row of the table of streams; a task plays the stream up to its first draw, at some ten nanoseconds a number.
STREAM_DRAWS = 50


def drawn(sizes: DataFrame, draws: int, step: int = STREAM_DRAWS) -> DataFrame:
    """(size, draw, pos, at): what random.Random(0) draws from so many rows with replacement, `size` numbers a draw, for each of sizes(size)."""
    blocks = sizes.select("size", F.explode(F.array(*[F.lit(k) for k in range(0, draws, step)])).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import random

        for batch in batches:
            for size, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, state, _ = random.Random(0).getstate()
                stream = np.random.MT19937()
                stream.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
                bits = size.bit_length()
                at, lo, hi = 0, first * size, min(draws, first + step) * size
                while at < hi:  # as randrange() draws: numbers of so many bits, those that are too large are drawn again
                    x = stream.random_raw(min(1 << 20, 2 * (hi - at) + 16)) >> np.uint64(32 - bits)
                    x = x[x < size].astype(np.int64)
                    k = np.arange(at, at + len(x))
                    keep = (k >= lo) & (k < hi)
                    at += len(x)
                    if keep.any():
                        k = k[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.full(len(k), size), k // size, k % size, x[keep])], names=["size", "draw", "pos", "at"])

    return blocks.repartition("size", "first").mapInArrow(run, "size long, draw long, pos long, at long")


def bootstrap_ci(df: DataFrame, by: list[str], draws: int = 1000, alpha: float = 0.05) -> DataFrame:
    """(by, lo, hi): the percentile interval of the average precision of samples with replacement, from one stream of seed 0.

    All samples of all groups are ranked at once; equal scores are in the order in which they were drawn, as
    average_precision_list() has them. A group has at most 2**32 rows.
    """
    values = average_precision(samples(df, by, draws), [*by, "draw"]).groupBy(*by).agg(F.array_sort(F.collect_list("ap")).alias("v"))  # a number for each draw
    return values.select(*by, F.get("v", F.lit(int(alpha / 2 * draws))).alias("lo"), F.get("v", F.lit(max(0, int((1 - alpha / 2) * draws) - 1))).alias("hi"))


def samples(df: DataFrame, by: list[str], draws: int) -> DataFrame:
    """(by, draw, label, score, ord): each group's samples; its rows, in the order of `ord`, meet the table of what is drawn from so many rows.

    Both sides are dealt by size and place, with hash tables of the rows. What is drawn looks to the optimiser as small as
    the table of sizes that it comes from, and would be sent whole through the driver.
    """
    placed = ranked(df, by, [F.asc("ord")], rank="_place").select(*by, "label", "score", (F.col("_place") - 1).alias("at"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("size"))
    placed = placed.join(sizes, by) if by else placed.crossJoin(F.broadcast(sizes))  # one row of sizes
    rows = drawn(sizes.select("size").where("size > 0").distinct(), draws).join(placed.hint("shuffle_hash"), ["size", "at"])
    return rows.select(*by, "draw", "label", "score", F.col("pos").alias("ord"))
