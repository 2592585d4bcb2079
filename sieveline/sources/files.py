"""File sources: line-numbered text, JSON lines, CSV, XML and tar members, and driver-side discovery."""

from __future__ import annotations

import gzip
import io
import json
import re
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions.scalars import normalize_doi
from ..schemas import ARTICLES, NOTICES, SIGNALS
from . import places

PUBMED_XML = (
    "MedlineCitation struct<PMID: string, Article: struct<Journal: struct<Title: string, ISOAbbreviation: string>, "
    "ELocationID: array<struct<_VALUE: string, _EIdType: string>>, PublicationTypeList: struct<PublicationType: array<string>>>, "
    "MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: string>>>, KeywordList: array<struct<Keyword: array<string>>>>, "
    "PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>, _corrupt_record string"
)


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(file, line_number, line) of non-blank lines of plain and gzip files; numbers count blank lines too.

    Numbers hold when a plain file is read in several splits, and no task holds more of a file than its own split.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    df = with_ordinal(reader.text(path), "line_number")
    return df.where(F.trim("value") != "").select("file", "line_number", F.trim("value").alias("line"))


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def source_rows(spark: SparkSession, folder: str | Path, name: str, schema: str) -> DataFrame:
    """Rows of <name>.jsonl, else of <name>.jsonl.gz, else of the shards <name>/*.jsonl.gz, else none."""
    for p in (places.join(folder, f"{name}.jsonl"), places.join(folder, f"{name}.jsonl.gz")):
        if places.exists(p):
            return json_lines(spark, p, schema)
    at = places.join(folder, name)
    shards = [places.join(at, n) for n in places.names(at, recursive=False) if n.endswith(".jsonl.gz")]
    return json_lines(spark, shards, schema) if shards else spark.createDataFrame([], schema)


def source_bundle(spark: SparkSession, folder: str | Path) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, official notices and external signals of a source folder; a precision that is not given is a day."""
    articles = source_rows(spark, folder, "articles", ARTICLES)
    none = F.array().cast("array<string>")
    filled = {c: F.coalesce(c, d) for c, d in (("publication_date_precision", F.lit("day")), ("authors", none), ("institutions", none))}
    return articles.withColumns(filled), source_rows(spark, folder, "official_notices", NOTICES), source_rows(spark, folder, "external_signals", SIGNALS)


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines of a text file or folder, gzip or not."""
    return spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "").count()


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON object, or an array of them, as rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct identifiers of a text file, one a line."""
    lines = spark.read.text(path)
    return lines.select(normalize_doi(F.col("value")).alias("doi")).where("doi != ''").distinct()


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """df, as it is read from files, with `file` and the rows' numbers within their files from 1 on, which hold where a file is read in several splits.

    A first scan counts the rows of each split; a running sum over a file's splits tells how many come before. Within
    a split rows are numbered as they are read, and nothing is sorted. Should the two scans be cut into unlike splits,
    the query fails.
    """
    df = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_i"))
    splits = df.groupBy("file", "_at", "_part").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"), F.max("_i").alias("_last"))
    earlier = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_at", "_part", "_n", "_first", "_last", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.when(F.col("_i").between(F.col("_first"), F.col("_last")) & (F.col("_last") - F.col("_first") + 1 == F.col("_n")), F.col("_i") - F.col("_first") + 1 + F.col("_before"))
    out = df.join(splits, ["file", "_at", "_part"], "left")
    return out.withColumn(name, F.coalesce(place, F.raise_error(F.lit("a file was read in unlike splits")).cast("long"))).drop("_at", "_part", "_i", "_n", "_first", "_last", "_before")


def csv_rows(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Header-driven rows of text columns; cells past the header are dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).csv(path)


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, head): each file's first line without white space around it or a byte order mark, read by tasks; empty files have an empty one. Bytes that are not UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            heads = []
            for path in batch.column(0).to_pylist():
                files, at = places.opened(path)
                head = b""
                with files.open_input_stream(at, compression="gzip" if path.lower().endswith(".gz") else None) as f:
                    while b"\n" not in head and (block := f.read(1 << 16)):
                        head += block
                heads.append(head.split(b"\n", 1)[0].decode("utf-8-sig", errors="replace").strip())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.string())], names=["file", "head"])

    rows = spark.createDataFrame([(p,) for p in paths], "file string")
    return rows.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "file string, head string")


def pubmed_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Index rows of XML article sets: doi, pmid, mesh_terms, keywords, publication_types, journal_title, and error; file and ordinal tell where from."""
    df = spark.read.format("xml").option("rowTag", "PubmedArticle").option("mode", "PERMISSIVE").option("recursiveFileLookup", True).schema(PUBMED_XML).load(path)
    df = with_ordinal(df)
    typed = lambda items, kind: F.get(F.filter(items, lambda x: (F.lower(x[kind]) == "doi") & (F.trim(x["_VALUE"]) != "")), 0)["_VALUE"]
    clean = lambda items: F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))
    a, b = "MedlineCitation.Article", "MedlineCitation.MeshHeadingList.MeshHeading"
    return df.select(
        F.trim(F.coalesce(typed(F.col("PubmedData.ArticleIdList.ArticleId"), "_IdType"), typed(F.col(f"{a}.ELocationID"), "_EIdType"), F.lit(""))).alias("doi"),
        F.trim(F.coalesce("MedlineCitation.PMID", F.lit(""))).alias("pmid"),
        clean(F.transform(F.col(b), lambda x: x["DescriptorName"])).alias("mesh_terms"),
        clean(F.flatten(F.transform(F.col("MedlineCitation.KeywordList"), lambda x: x["Keyword"]))).alias("keywords"),
        clean(F.col(f"{a}.PublicationTypeList.PublicationType")).alias("publication_types"),
        F.trim(F.coalesce(f"{a}.Journal.Title", f"{a}.Journal.ISOAbbreviation", F.lit(""))).alias("journal_title"),
        F.col("_corrupt_record").alias("error"),
        "file",
        "ordinal",
    )


def dois_in_xml(text: Column) -> Column:
    """Normalised identifiers of the elements of XML text that hold one, in its order; an element may hold other elements, escaped or not."""
    found = F.regexp_extract_all(text, F.lit(r'(?is)<(ArticleId|ELocationID)\b[^>]*?\bE?IdType\s*=\s*["\']doi["\'][^>]*>(.*?)</\1\s*>'), F.lit(2))
    return F.filter(F.transform(found, lambda x: normalize_doi(strip_tags(unescape(x)))), lambda x: x != "")


def _opened(uri: str):
    """(file system, path) of a path as Spark names it."""
    from pyarrow import fs as pafs

    uri = uri if "://" in uri else f"file://{uri.removeprefix('file:')}"
    return pafs.FileSystem.from_uri(uri)


#: Bytes of a file that one row of byte_ranges() is for, and bytes before and after that are read with them.
CHUNK_BYTES, OVERLAP_BYTES = 1 << 20, 64 << 10


def byte_ranges(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(file, start, stop) of the files of a folder, a row for each `chunk` bytes; gzip files, which cannot be cut, have one each, without a stop."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length")
    packed = F.lower("file").endswith(".gz")
    start = F.when(packed | (F.col("length") == 0), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long")))
    return found.select("file", F.explode(start).alias("start"), "length", packed.alias("packed")).select("file", "start", F.when(~F.col("packed"), F.least(F.col("start") + chunk, F.col("length"))).alias("stop"))


def xml_elements(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """(file, at, element): each element of XML files that holds an identifier, with its first byte. Elements and what they lie in are at most `overlap` bytes long.

    Ranges of a file are tasks of their own. Each reads `overlap` bytes more on both sides, and keeps the elements that
    start within its range, so one across a border is found once.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(file: str, data: bytes, base: int, start: int, stop: int) -> pa.RecordBatch:
            hits = [(base + m.start(), m[0].decode("utf-8", errors="replace")) for m in _IDENTIFIER.finditer(data) if start <= base + m.start() < stop]
            return pa.RecordBatch.from_arrays([pa.array([file] * len(hits), pa.string()), pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.string())], names=["file", "at", "element"])

        for batch in batches:
            for file, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                files, name = _opened(file)
                if stop is not None:
                    with files.open_input_file(name) as source:
                        low = max(0, start - overlap)
                        yield found(file, source.read_at(stop + overlap - low, low), low, start, stop)
                    continue
                with files.open_input_stream(name, compression="gzip") as source:
                    data, base, start = b"", 0, 0
                    while True:
                        more = source.read(chunk)
                        data += more
                        stop = base + len(data) - (overlap if more else 0)
                        if stop > start:
                            yield found(file, data, base, start, stop)
                            start = stop
                            cut = max(0, stop - overlap - base)
                            data, base = data[cut:], base + cut
                        if not more:
                            break

    ranges = byte_ranges(spark, path, chunk)
    return ranges.repartition("file", "start").mapInArrow(run, "file string, at long, element string")


#: As in dois_in_xml(), over bytes.
_IDENTIFIER = re.compile(rb"""(?is)<(ArticleId|ELocationID)\b[^>]*?\bE?IdType\s*=\s*["']doi["'][^>]*>(.*?)</\1\s*>""")


def xml_dois(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """dois_in_xml() of a folder's files, a row each."""
    return xml_elements(spark, path, chunk, overlap).select(F.explode(dois_in_xml(F.col("element"))).alias("doi"))


def unescape(c: Column) -> Column:
    """Text with the named references of XML and numeric ones, decimal or hexadecimal, undone, once each."""
    parts = F.split(c, "(?=&[#a-zA-Z0-9]{1,31};)")

    def whole(part: Column) -> Column:
        name, rest = F.regexp_extract(part, "^&([#a-zA-Z0-9]{1,31});", 1), F.regexp_replace(part, "^&[#a-zA-Z0-9]{1,31};", "")
        number = F.when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, 2, 7).try_cast("int")).when(name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(name, 3, 6), 16, 10).try_cast("int"))
        # the four bytes of a code point, read as UTF-32
        char = F.when(number.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        for known, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
            char = F.coalesce(char, F.when(name == known, F.lit(value)))
        return F.coalesce(F.concat(char, rest), part)

    return F.array_join(F.transform(parts, whole), "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def member_records(data: bytes, name: str) -> Iterator[dict]:
    """Objects of one archive member: each line is an object or an array of objects; lines that do not parse, and what is no object, are left out."""
    if name.endswith(".gz"):
        data = gzip.decompress(data)
    for line in data.decode("utf-8", errors="replace").split("\n"):
        try:
            x = json.loads(line)
        except ValueError:
            continue
        yield from (y for y in (x if isinstance(x, list) else [x]) if isinstance(y, dict))


#: Bytes of archive members that one task parses, about, and how many a byte of a gzip archive is taken to hold.
MEMBER_BYTES, PACKED = 16 << 20, 4


@dataclass
class _Members(InputPartition):
    """Members (name, first byte, bytes) that one task reads; None for the whole of an archive that cannot be cut."""

    members: list[tuple[str, int, int]] | None


class TarSource(DataSource):
    """spark.read.format("tar_members").load(path): (member, data) of a tar archive.

    A first pass over the headers of a plain archive gives the places of its members, which tasks then read by
    themselves. A gzip archive is one stream, so one task cuts it into members.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "member string, data binary"

    def reader(self, schema):
        return _TarReader(self.options.get("path", ""), int(self.options.get("member_bytes", MEMBER_BYTES)))


class _TarReader(DataSourceReader):
    def __init__(self, path: str, member_bytes: int):
        self.path, self.member_bytes = path, member_bytes

    def partitions(self) -> list[InputPartition]:
        files, path = _opened(self.path)
        with files.open_input_file(path) as raw:
            if raw.read(2) == b"\x1f\x8b":
                return [_Members(None)]
            raw.seek(0)
            parts, size = [[]], 0
            with tarfile.open(fileobj=raw, mode="r:") as tar:
                for m in tar:
                    if m.isfile():
                        if size and size + m.size > self.member_bytes:
                            parts.append([])
                            size = 0
                        parts[-1].append((m.name, m.offset_data, m.size))
                        size += m.size
        return [_Members(p) for p in parts]

    def read(self, partition):
        files, path = _opened(self.path)
        if partition.members is not None:
            with files.open_input_file(path) as raw:
                for name, at, size in partition.members:
                    yield name, raw.read_at(size, at)
            return
        with files.open_input_stream(path, compression=None) as raw, tarfile.open(fileobj=io.BufferedReader(raw), mode="r|*") as tar:
            for member in tar:
                if member.isfile():
                    yield member.name, tar.extractfile(member).read()


class TarJsonSource(TarSource):
    """spark.read.format("tar_json").load(path): (member, ordinal, json) of a tar archive; tasks as in tar_members, each parses what it reads."""

    @classmethod
    def name(cls) -> str:
        return "tar_json"

    def schema(self) -> str:
        return "member string, ordinal bigint, json string"

    def reader(self, schema):
        return _TarJsonReader(self.options.get("path", ""), int(self.options.get("member_bytes", MEMBER_BYTES)))


class _TarJsonReader(_TarReader):
    def read(self, partition):
        for name, data in super().read(partition):
            for k, x in enumerate(member_records(data, name)):
                yield name, k, json.dumps(x)


def tar_records(spark: SparkSession, path: str, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """(member, ordinal, json) of the objects in a tar archive, gzip or not; members are parsed by many tasks in either case."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [json.dumps(x) for x in member_records(data.as_py(), name)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], names=["member", "ordinal", "json"])

    spark.dataSource.register(TarSource)
    members = spark.read.format("tar_members").option("member_bytes", member_bytes).load(path)
    files, name = _opened(path)
    with files.open_input_file(name) as raw:
        tasks = -(-PACKED * raw.size() // member_bytes)
        if raw.read(2) == b"\x1f\x8b" and tasks > 1:
            members = members.repartition(tasks, "member")
    return members.mapInArrow(run, "member string, ordinal long, json string")


def latest_dated(names: list[str], bound: date) -> str | None:
    """The latest YYYY-MM-DD name that is not after the bound."""
    dated = sorted(n for n in names if re.fullmatch(r"\d{4}-\d{2}-\d{2}", n) and date.fromisoformat(n) <= bound)
    return dated[-1] if dated else None


def first_match(names: list[str], wanted: list[str]) -> str | None:
    """The first name, in order, that equals a wanted one or ends with it."""
    return next((n for w in wanted for n in sorted(names) if n == w or n.endswith(w)), None)


def classify_sources(df: DataFrame, path: str = "path", head: str = "head") -> DataFrame:
    """df with bucket and reason, from the first lines of each file and its path."""
    h, p = F.lower(F.coalesce(head, F.lit(""))), F.lower(path)
    rules = [
        (h.contains("<pubmedarticle"), "pubmed", "xml_root"),
        (h.rlike('"(authorships|referenced_works|primary_location)"'), "openalex", "json_key"),
        (h.rlike('"(update-to|notice_type|relation)"'), "official_notices", "json_key"),
        (h.rlike("(retractionnature|notice_type)") & h.contains(","), "official_notices", "csv_header"),
        (h.rlike('"(pmid|mesh_terms)"|(^|,)pmid,'), "pubmed", "json_key"),
        (p.contains("openalex"), "openalex", "path"),
        (p.contains("pubmed"), "pubmed", "path"),
        (p.rlike("retraction|crossref|notice"), "official_notices", "path"),
    ]
    bucket, reason = F, F
    for cond, b, r in rules:
        bucket, reason = bucket.when(cond, F.lit(b)), reason.when(cond, F.lit(r))
    return df.withColumn("bucket", bucket.otherwise(F.lit("unknown"))).withColumn("reason", reason.otherwise(F.lit("no_rule")))


def unknown_sources(classified: DataFrame) -> DataFrame:
    """Files that no rule or override placed, with a blank bucket to fill in: a template for overrides."""
    return classified.where("bucket = 'unknown'").select("path", F.lit("").alias("bucket"), "reason")


def apply_overrides(classified: DataFrame, overrides: DataFrame) -> DataFrame:
    o = overrides.select("path", F.col("bucket").alias("_bucket"))
    out = classified.join(o, "path", "left")
    return out.withColumn("reason", F.when(F.col("_bucket").isNotNull(), F.lit("override")).otherwise(F.col("reason"))).withColumn("bucket", F.coalesce("_bucket", "bucket")).drop("_bucket")


def bucket_readiness(files: DataFrame, suffixes: dict[str, tuple[str, ...]], sidecars: tuple[str, ...] = ("source_versions.json", "sha256_manifest.tsv")) -> DataFrame:
    """(bucket, supported, sidecar, unsupported, ready) of files(bucket, path); a bucket without files is not ready."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    side = name.isin(*sidecars)
    supported = F.lit(False)
    for bucket, ends in suffixes.items():
        supported = supported | ((F.col("bucket") == bucket) & name.rlike("(" + "|".join(e.replace(".", r"\.") for e in ends) + ")$"))
    all_ = files.sparkSession.createDataFrame([(b,) for b in suffixes], "bucket string")
    got = files.groupBy("bucket").agg(F.count_if(supported & ~side).alias("supported"), F.count_if(side).alias("sidecar"), F.count_if(~supported & ~side).alias("unsupported"))
    out = all_.join(got, "bucket", "left").fillna(0, ["supported", "sidecar", "unsupported"])
    return out.withColumn("ready", (F.col("supported") > 0) & (F.col("unsupported") == 0))
