"""Control plane: registered files, frozen checks, upserts and incremental skips as DataFrame operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import places

FILES = "snapshot_id string, file_id string, collector_name string, relative_path string, content_sha256 string, size_bytes bigint, parse_status string, parsed_rows bigint, quarantined_rows bigint"


#: Bytes that hashing holds of a file.
READ_BYTES = 1 << 20


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(relative_path, content_sha256, size_bytes) of files below root with one of the suffixes, in any case, empty ones too.

    Names and sizes are listed once; tasks read their files block by block, so a file's size does not matter and no
    content reaches the driver. A root without such files gives no rows.
    """
    from pyarrow import fs as pafs

    files, base = places.opened(root)
    listed = [f for f in files.get_file_info(pafs.FileSelector(base, recursive=True)) if f.type == pafs.FileType.File and f.path.lower().endswith(suffixes)]
    rows = spark.createDataFrame([(f.path[len(base) :].lstrip("/"), f.size) for f in listed], "relative_path string, size_bytes long")

    def run(batches):
        import hashlib

        import pyarrow as pa

        files, base = places.opened(root)
        for batch in batches:
            digests = []
            for name in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    while block := stream.read(READ_BYTES):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), batch.column(1)], names=["relative_path", "content_sha256", "size_bytes"])

    tasks = max(1, min(len(listed), 16 * spark.sparkContext.defaultParallelism))
    return rows.repartition(tasks, "relative_path").mapInArrow(run, "relative_path string, content_sha256 string, size_bytes long")


def stable_file_id(snapshot: str, collector: str, path: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{snapshot}|{collector}|{path}").hex


def file_id(snapshot: str, collector: str | Column, path: str | Column) -> Column:
    """stable_file_id() as a column: a version 5 UUID is a SHA-1 with a version digit and a variant digit."""
    name = F.concat(F.lit(f"{snapshot}|"), collector, F.lit("|"), path)
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def snapshot_diff(registered: DataFrame, on_disk: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) of what differs: missing, added or modified."""
    a, b = registered.select(key, F.col(value).alias("_old"), F.lit(1).alias("_a")), on_disk.select(key, F.col(value).alias("_new"), F.lit(1).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return a.join(b, key, "full_outer").withColumn("state", state).where("state is not null").select(key, "state")


class SnapshotChanged(RuntimeError):
    """A registered snapshot no longer is what it was."""


def assert_frozen(registered: DataFrame, on_disk: DataFrame) -> None:
    rows = snapshot_diff(registered, on_disk, "relative_path", "content_sha256").orderBy("state", "relative_path").limit(20).collect()
    if rows:
        raise SnapshotChanged("; ".join(f"{r.state}: {r.relative_path}" for r in rows))


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Rows of both by key; the highest version stays."""
    return latest_version(current.unionByName(changes), keys, version)


def latest_version(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Of the rows of each key the one with the highest version."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(version.desc()))).where("_rn = 1").drop("_rn")


def pending_files(files: DataFrame, done: DataFrame, keys: tuple[str, ...] | list[str] = ("content_sha256", "config")) -> DataFrame:
    """Files without a successful parse of the same content under the same configuration."""
    return files.join(done.where("parse_status = 'success'"), list(keys), "left_anti")


def latest_as_of(df: DataFrame, keys: list[str], date: str, bound: Column, order: list[Column]) -> DataFrame:
    """For each key the latest row not after the bound."""
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc(), *order)
    return df.where(F.col(date) <= bound).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def error_counts(files: DataFrame, errors: DataFrame) -> DataFrame:
    return errors.join(files.select("file_id", "collector_name"), "file_id").groupBy("collector_name", "error_code").agg(F.count("*").alias("n"))


def inventory(files: DataFrame) -> DataFrame:
    """(bucket, files, bytes) of files(bucket, size_bytes)."""
    return files.groupBy("bucket").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def collector_counts(files: DataFrame) -> DataFrame:
    """(collector_name, files, parsed_rows, quarantined_rows) of registered files."""
    return files.groupBy("collector_name").agg(F.count("*").alias("files"), F.sum("parsed_rows").alias("parsed_rows"), F.sum("quarantined_rows").alias("quarantined_rows"))


def collection_summary(articles: DataFrame) -> DataFrame:
    """Counts and missing shares of the canonical articles, one row."""
    n = F.greatest(F.lit(1), F.count("*"))
    missing = lambda cond: F.round(F.count_if(cond) / n, 4)
    return articles.agg(
        F.count("*").alias("articles"),
        missing(F.trim(F.coalesce("abstract", F.lit(""))) == "").alias("missing_abstract_rate"),
        missing(F.size("authors") == 0).alias("missing_authors_rate"),
        missing(F.col("venue") == "Unknown Venue").alias("missing_venue_rate"),
        F.count_if(F.col("publication_date_precision") == "day").alias("day_precision"),
        F.count_if(F.col("publication_date_precision") == "month_imputed").alias("month_precision"),
        F.count_if(F.col("publication_date_precision") == "year_imputed").alias("year_precision"),
    )
