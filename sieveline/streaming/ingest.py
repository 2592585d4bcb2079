"""A file-source stream of raw lines through the batch normalisers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def raw_lines(spark: SparkSession, path: str, snapshot_id: str, files_per_batch: int = 64) -> DataFrame:
    """(line, file_id, line_number, snapshot_id) of new files; a stream has no file-wide order, so line numbers are null."""
    df = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).text(path)
    return df.where(F.trim("value") != "").select(
        F.trim("value").alias("line"), F.sha2(F.col("_metadata.file_path"), 256).alias("file_id"), F.lit(None).cast("long").alias("line_number"), F.lit(snapshot_id).alias("snapshot_id")
    )


def ingest(lines: DataFrame, normalize: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Normalise what is new and append it below `out`, one folder per kind of outcome, then stop.

    The checkpoint remembers files that are done, and a batch's folder is overwritten if it runs again, so each file
    counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = normalize(batch).withColumn("batch", F.lit(batch_id))
        done.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={batch_id}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_by_window(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by window and type; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
