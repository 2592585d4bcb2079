"""Token ids in fixed-width bit packing, with block offsets for vectorised unpacking and random access.

A file holds one run of documents. Layout (little-endian): magic "SLTB", u16 version, u8 bits per id, u8 zero,
u32 ids per block, then the blocks: each block's ids packed at the fixed width, least significant bit first, padded
to a byte. Then the footer: u64 byte offset of each block, u64 position of the end of each document (in ids), and the
trailer: u64 blocks, u64 documents, u64 ids, u64 offset of the footer, magic "BTLS".
"""

from __future__ import annotations

import functools
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import file_system, fresh_dir, written

MAGIC, END, VERSION = b"SLTB", b"BTLS", 1
BLOCK_IDS = 1 << 16
END_ID = 1
#: Entries of a Python worker's word cache; it is emptied when full.
CACHE_WORDS = 900_000
#: Bytes of text, and documents, that one part of the output is made from, about.
PART_BYTES, PART_ROWS = 32 << 20, 100_000
#: Documents of one row of the index, which are read back together.
INDEX_ROWS = 16_384
#: Files at most: beyond that they grow. The task that writes one holds a block of token ids, INDEX_ROWS document ids, and an end for each document.
MAX_PARTS = 100_000

# The word pattern and normalisation of the "word_bpe" family of tokenizer files.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Text in which the shortcut below is used: no control, combining or unassigned characters, no capital dotted I.
_PLAIN = regex.compile(r"[\x21-\x7E\xA1-įı-ɏ]+")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at a fixed width, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


class TokenFileWriter:
    """Writes documents' ids to an open binary file, a block at a time."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.at = self.out.write(MAGIC + struct.pack("<HBBI", VERSION, bits, 0, block_ids))
        self.offsets: list[int] = []
        self.ends: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.ends.append(self.n)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            ids = np.concatenate(self.held)
            whole = self.n_held // self.block_ids * self.block_ids
            for k in range(0, whole, self.block_ids):
                self._block(ids[k : k + self.block_ids])
            self.held, self.n_held = [ids[whole:]], self.n_held - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.out.write(pack(ids, self.bits))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        footer = np.array(self.offsets, "<u8").tobytes() + np.array(self.ends, "<u8").tobytes()
        self.out.write(footer + struct.pack("<QQQQ", len(self.offsets), len(self.ends), self.n, self.at) + END)


class TokenFile:
    """Random access to a file's documents: ids(k) reads only the blocks that document k lies in."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        head = source.read_at(12, 0)
        tail = source.read_at(36, size - 36)
        if head[:4] != MAGIC or tail[-4:] != END:
            raise ValueError("not a token file")
        _, self.bits, _, self.block_ids = struct.unpack("<HBBI", head[4:])
        blocks, docs, self.n, at = struct.unpack("<QQQQ", tail[:32])
        footer = source.read_at(size - 36 - at, at)
        self.offsets = np.frombuffer(footer, "<u8", blocks)
        self.ends = np.frombuffer(footer, "<u8", docs, 8 * blocks)

    def __len__(self) -> int:
        return len(self.ends)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n - k * self.block_ids)
        return unpack(self.source.read_at((n * self.bits + 7) // 8, int(self.offsets[k])), n, self.bits)

    def slice(self, lo: int, hi: int) -> np.ndarray:
        if lo >= hi:
            return np.empty(0, np.uint32)
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        ids = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return ids[lo - first * self.block_ids : hi - first * self.block_ids]

    def ids(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
        """Documents first to last in order, all of them by default; each block is read and unpacked once."""
        lo, k, block = int(self.ends[first - 1]) if first else 0, -1, np.empty(0, np.uint32)
        for hi in self.ends[first:last].tolist():
            parts = []
            while lo < hi:
                if lo // self.block_ids != k:
                    k = lo // self.block_ids
                    block = self.block(k)
                at = lo - k * self.block_ids
                parts.append(block[at : at + hi - lo])
                lo += len(parts[-1])
            yield np.concatenate(parts) if parts else np.empty(0, np.uint32)


class WordCachedEncoder:
    """Ids of whole texts by a tokenizers file, word by word where that provably gives the same ids.

    Its pattern never matches across white space and its normaliser works within words, so a text's ids are its words'
    ids in order. Each distinct word is encoded once and kept; plain Latin words skip the normaliser. Any text with a
    special token's start or an odd control character, and any tokenizer of another make, takes the library's own
    encode on the whole text. Tests hold the two against each other.
    """

    def __init__(self, path: str, capacity: int = CACHE_WORDS):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in ((made.get("normalizer") or {}).get("normalizers") or [])]
        pre = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and (pre[0].get("pattern") or {}).get("Regex") == _WORD_SPLIT
        self.model, self.split = self.tokenizer.model, regex.compile(_WORD_SPLIT)
        self.capacity, self.words, self.pieces = capacity, {}, {}
        self.alphabet = _byte_alphabet()

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word):
            out = []
            for piece in self.split.findall(unicodedata.normalize("NFC", word).lower()):
                ids = self.pieces.get(piece)
                if ids is None:
                    ids = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))], "<u4").tobytes()
                out.append(ids)
            ids = b"".join(out)
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_word or "<|" in text or regex.search(r"[\x1c-\x1f]", text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) + len(self.pieces) > self.capacity:
            self.words.clear()
            self.pieces.clear()
        get, make = self.words.get, self._word
        return b"".join([x if (x := get(w)) is not None else make(w) for w in text.split()])


@functools.lru_cache(maxsize=2)
def encoder_for(path: str) -> WordCachedEncoder:
    """One encoder for a tokenizer in each Python worker, so that its word cache outlives a task."""
    return WordCachedEncoder(path)


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_INDEX = "part long, file string, first long, n_docs long, n_ids long, doc_ids array<long>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode each text, append end_id, and write the ids below path in ascending id order; returns the index (part, file, first, n_docs, n_ids, doc_ids).

    A row of the index is for the file's documents from number first on, INDEX_ROWS at most, with their ids and how
    many token ids they have. Rows are range-partitioned by id and sorted; each task writes one file under a name of
    its own attempt and returns it, so a task that runs twice leaves a stray file but no wrong one. Files follow from
    bytes and rows, and rows that agree in id and text can lie in several. Null texts are empty; null ids come first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    size = total.bytes or 0
    parts = max(1, min(MAX_PARTS, max(-(-size // PART_BYTES), -(-total.rows // PART_ROWS))), min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20))
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary")), "nth").drop("nth").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        encoder = encoder_for(tokenizer)
        bits = bits_for(max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
        files, root = file_system(path)
        files.create_dir(root, recursive=True)
        name = f"tokens-{part:06d}-{attempt}.bin"
        end = struct.pack("<I", end_id)
        ids: list[int | None] = []
        first = before = 0

        def index() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name, first, len(ids), writer.n - before)] + [pa.array([ids], pa.list_(pa.int64()))], names=["part", "file", "first", "n_docs", "n_ids", "doc_ids"])

        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            writer = TokenFileWriter(out, bits, block_ids)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if len(ids) == INDEX_ROWS:
                        yield index()
                        first, before, ids = first + len(ids), writer.n, []
                    ids.append(doc_id)
                    writer.add(np.frombuffer(encoder.encode(text.as_py()) + end, "<u4"))
            writer.close()
        if ids:
            yield index()

    return rows.mapInArrow(run, _INDEX)


def token_documents(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files, read them back, and return (doc_id, start, n_tokens, ids_crc32) per row of docs.

    start: ids of all rows before it in file order; crc of the ids as little-endian unsigned 32-bit integers. An empty
    text has the end id alone; rows that repeat are documents of their own, side by side. An empty table gives no files
    and no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "tokens")
    index = written(write_token_files(docs, path, tokenizer, end_id, id_col, text_col), "token-index")[0]
    # ids of all files before, one row for each of MAX_PARTS files at most: a running sum and a join of a few numbers
    sums = index.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    sums = sums.select("part", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("before"))
    rows = index.select("part", "file", "first", "doc_ids").join(sums, "part").select("file", "first", "before", "doc_ids").repartition(max(1, index.count()), "file", "first")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(path)
        for batch in batches:
            for file, first, before, ids in zip(*(c.to_pylist() for c in batch.columns)):
                last = first + len(ids)
                with files.open_input_file(f"{root}/{file}") as source:
                    book = TokenFile(source)
                    crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in book.documents(first, last)]
                ends = book.ends[max(0, first - 1) : last].astype(np.int64)
                n = np.diff(ends, prepend=0)[1 if first else 0 :]
                ends = ends[1 if first else 0 :]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(before + ends - n), pa.array(n), pa.array(crcs, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
