"""Row numbers and running sums over any order, without a task that holds a group: ranges of the order, sums before each range, and ranks within it."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names. Where it is unset, a local master (tests) gets a new one and a cluster an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="sieveline-checkpoint-")
        context.setCheckpointDir(root)
    return df.checkpoint()


def ranked(df: DataFrame, by: list[str], order: list[Column], summed: str | None = None, rank: str = "rank", total: str = "hits") -> DataFrame:
    """df with each row's number within its group `by` in this order, from 1, and the sum of `summed` up to it.

    Rows are range-partitioned by group and order, so a group, and rows of one score, lie in as many ranges as they
    need; a table with a row for each group and range tells what comes before. Rows with a null in `by` go.
    """
    ranges = df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    held = cut(ranges)
    value = F.col(summed) if summed else F.lit(0)
    sums = held.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    own = Window.partitionBy(*by, "_range").orderBy(*order)
    out = held.withColumn("_rank", F.row_number().over(own))
    if summed:
        out = out.withColumn("_sum", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(sums, [*by, "_range"]).withColumn(rank, F.col("_n") + F.col("_rank"))
    if summed:
        out = out.withColumn(total, F.col("_s") + F.col("_sum"))
    return out.drop("_rank", "_sum", "_n", "_s", "_range")
