"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES. The file ends with the seek table of the public
"seekable format": a skippable frame that lists each frame's compressed and decompressed size. The index maps a
record's identifier to its frame and its offset in the decompressed frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, fresh_dir, materialize, utf8

FRAME_BYTES = 1 << 20
#: Payloads under this are never revisits.
MIN_REVISIT = 1000
LEVEL = 3
#: A payload with over this part of all repeated rows is matched by broadcast, so that no task gets all its copies.
HOT_PART = 10_000
#: Neighbouring frames that one task reads together, and about how many a partition of the read has.
RUN_FRAMES, TASK_FRAMES, MAX_TASKS = 4, 64, 50_000

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    x = urn.strip("<>").rpartition(":")[2]
    return None if x == "none" else int(x)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, is_revisit: bool, when: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record: response with the payload, or revisit that names the response and has no payload."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    body = b"" if is_revisit else payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, end) of the record that begins at an offset."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = head_end + 4
    end = body + int(head["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record is not closed")
    return head, data[body:end], end + 4


class BundleWriter:
    """Writes records to an open binary stream, frame by frame; add() gives (frame, offset in the frame)."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.size and self.size + len(data) > self.frame_bytes:
            self._flush()
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def _flush(self) -> None:
        packed = self.zstd.compress(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class Bundle:
    """Reads a bundle by its seek table; read_at(n, offset) and size() are all it needs of the file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError("no seek table")
        table = source.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        head, body, _ = parse_record(self.frame(frame), offset)
        return head, body

    def records(self, frame: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
        data, at = self.frame(frame), 0
        while at < len(data):
            begin = at
            head, body, at = parse_record(data, at)
            yield begin, head, body


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write pages below path, one bundle a task, and return the index (archive, frame, offset, page_id), written once.

    Of equal payloads of MIN_REVISIT bytes or more (by SHA-256), the one with the largest id is the response and the
    others revisit it; all smaller ones are responses. Null html is empty; rows with a null id are responses unless a
    copy has an id. Rows that repeat the largest id are all responses. A task that runs twice leaves a stray file,
    but only the file of the attempt that counted is in the index.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(F.col(html_col)).alias("payload"))
    large = F.length("payload") >= MIN_REVISIT
    digests = rows.where(large).select("page_id", F.sha2("payload", 256).alias("key"))
    largest = materialize(digests.groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-copies")
    repeats = largest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT_PART > repeats  # HOT_PART keys at most, whatever the input
    # payloads that nothing else is joined to get keys of another form, which spread over the tasks
    alone = F.concat(F.lit("-"), F.hex(F.xxhash64("page_id", "url", "payload")))
    keyed = rows.withColumn("key", F.when(large, F.sha2("payload", 256)).otherwise(alone))
    keyed = keyed.join(F.broadcast(largest.where(hot).select("key", F.col("first").alias("hot_first"), F.lit(True).alias("is_hot"))), "key", "left")
    keyed = keyed.withColumn("key", F.when(F.col("is_hot"), alone).otherwise(F.col("key")))
    # a written table, whose size decides whether payloads are shuffled at all
    joined = keyed.join(largest.where(~hot).select("key", "first"), "key", "left").withColumn("first", F.coalesce("hot_first", "first"))
    joined = joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.zst"
        files, root = file_system(path)
        files.create_dir(root, recursive=True)
        writer, out = None, None
        try:
            for batch in batches:
                places: list[tuple[int, int]] = []
                ids = batch.column(0).to_pylist()
                for page_id, url, payload, first in zip(ids, batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                    if writer is None:
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                        writer = BundleWriter(out, frame_bytes)
                    payload = payload.as_py()
                    places.append(writer.add(record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), first, first is not None)))
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(ids)), pa.array([p[0] for p in places], pa.int32()), pa.array([p[1] for p in places], pa.int64()), pa.array(ids, pa.int64())],
                        names=["archive", "frame", "offset", "page_id"],
                    )
            if writer is not None:
                writer.close()
        finally:
            if out is not None:
                out.close()

    index = joined.mapInArrow(run, "archive string, frame int, offset long, page_id long")
    at = f"{path.rstrip('/')}/_index"
    index.write.parquet(at)
    return pages.sparkSession.read.schema(index.schema).parquet(at)


def read_archives(archives: DataFrame, path: str) -> DataFrame:
    """All records of archives(archive, frame): (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Frames are listed from each file's own seek table and dealt out in short runs of one file, over a number of
    partitions that follows from the number of frames in the index; a response's length and digest are taken from the
    payload that was read, and its digest header must agree. A revisit has no payload but its headers.
    """
    n_frames = archives.groupBy("archive").agg((F.max("frame") + 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, min(-(-n_frames // RUN_FRAMES), max(archives.sparkSession.sparkContext.defaultParallelism, min(MAX_TASKS, n_frames // TASK_FRAMES))))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(f"{root}/{name}") as f:
                    n = len(Bundle(f).frames)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int32())], names=["archive", "frame"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(path)
        name, source, bundle = None, None, None
        for batch in batches:
            for archive, k in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    if source is not None:
                        source.close()
                    source = files.open_input_file(f"{root}/{archive}")
                    name, bundle = archive, Bundle(source)
                out: list[list] = [[] for _ in range(7)]
                for _, head, body in bundle.records(k):
                    sha1 = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    revisit = head["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(body).hexdigest() != sha1:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    refers = page_of(head["WARC-Refers-To"]) if revisit else None
                    row = (page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], None if revisit else body, int(head["X-Payload-Length"]) if revisit else len(body), sha1, head["WARC-Type"], refers)
                    for col, x in zip(out, row):
                        col.append(x)
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

        if source is not None:
            source.close()

    listed = archives.select("archive").distinct().mapInArrow(frames, "archive string, frame int")
    dealt = listed.repartition(tasks, "archive", F.expr(f"frame div {RUN_FRAMES}")).sortWithinPartitions("archive", "frame")
    return dealt.mapInArrow(records, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives, read the archives back, and return (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    path = path or fresh_dir(pages.sparkSession, "warc")
    index = write_archives(pages, path)
    return read_archives(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
