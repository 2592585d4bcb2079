"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process made; those that are left go when it ends.
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a new one and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", root)
        _made.add(root)
    elif "://" not in root:  # Spark takes such a path on its default file system, and so must the tasks' own files
        default = spark.conf.get("spark.hadoop.fs.defaultFS", None) or "file:"
        root = ("file://" if default.startswith("file:") else default.rstrip("/")) + root
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it; a path without a scheme is one of the machine's own."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def discard(path: str) -> None:
    """Remove a folder of fresh_dir() that nothing refers to any more; one that cannot be removed from here is left."""
    try:
        files, root = file_system(path)
        if files.get_file_info(root).type == pafs.FileType.Directory:
            files.delete_dir(root)
    except (OSError, pa.ArrowException):
        pass
    _made.discard(path)


@atexit.register
def _discard_all() -> None:
    for path in sorted(_made):
        discard(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    return written(df, tag)[0]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """materialize(), with the folder, for those that discard it before the process ends."""
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, tag: str, *keys: str) -> DataFrame:
    """materialize() in as many buckets of the keys as shuffles have partitions: joins and groupings by the keys read it as it lies, and only what it meets is shuffled."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_dir(spark, tag)
    name = f"{tag}_{uuid.uuid4().hex}".replace("-", "_")
    # one bucket a task, so one file a bucket
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(name, format="parquet")
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name goes, the files stay
    return stored


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def in_training_fold(doc_id: Column) -> Column:
    """True where crc32 of the decimal doc_id leaves a remainder other than 1 by 3 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the input does not have, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the training fold: ids whose labels are all 0 or all 1. Null ids and labels, other values, and ids whose labels disagree teach nothing."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & in_training_fold(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other"))
    return y.where("y = other").select("doc_id", "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], dict[int, int]]:
    """A bounded sample of the training fold's labelled texts, and how many rows each label has in all.

    For each of the labels 0 and 1: at most `rows` ids in the order of a hash, as far as their whole texts stay within
    `max_bytes`. Only ids and lengths of that many rows, and then those texts, reach the driver. Null texts are left
    out; labels are taken as training_labels() says.
    """
    y = training_labels(labels, label)
    counts = {r.y: r.n for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [r for k in (0, 1) for r in y.where(F.col("y") == k).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows).collect()]
    if not picked:
        return [], counts
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def of(ids: list[int]) -> DataFrame:
        return named.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id")

    lengths = dict(of([r.doc_id for r in picked]).groupBy("doc_id").agg(F.max(F.octet_length("text"))).collect())
    chosen, used = {}, {0: 0, 1: 0}
    for r in picked:
        n = lengths.get(r.doc_id)
        if n is not None and used[r.y] + n <= max_bytes:
            used[r.y] += n
            chosen[r.doc_id] = r.y
    if not chosen:
        return [], counts
    texts = {r.doc_id: r.text for r in of(list(chosen)).groupBy("doc_id").agg(F.max("text").alias("text")).toLocalIterator()}
    return [(texts[i], chosen[i]) for i in sorted(texts)], counts
