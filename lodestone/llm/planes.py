"""Operator 9: token ids in a bit-plane file format.

A file holds the ids of a run of documents. Ids are cut into blocks of a fixed number;
each block is transposed into bit planes (or byte planes), and each plane is compressed
with zstandard by itself, so that planes that are nearly constant shrink to almost
nothing. A footer holds the chunk index and the documents' ids and lengths; any block is
read without the others.

File: planes, then the footer (zstandard-compressed JSON and arrays), then the footer's
length as 8 little-endian bytes, then ``MAGIC``.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.blocks import IS_SPACE, Slice, byte_mask, merged, slices
from lodestone.llm.pieces import PieceCache
from lodestone.llm.shared import documents, new_path, written

MAGIC = b"LSPLANE1"
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 16
#: Ids to aim for in one file.
FILE_IDS = 1 << 24


def split_planes(ids: np.ndarray, bits: int, mode: str) -> list[np.ndarray]:
    """The planes of a block of unsigned ids, the least significant first."""
    if mode == "byte":
        return list(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : -(-bits // 8)].T.copy())
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return list(np.packbits(raw.T, axis=1, bitorder="little"))


def join_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """The ids of a block from its planes."""
    if mode == "byte":
        out = np.zeros((n, 4), dtype=np.uint8)
        for i, plane in enumerate(planes):
            out[:, i] = np.frombuffer(plane, dtype=np.uint8)
        return out.reshape(-1).view("<u4")
    bits = np.zeros((32, n), dtype=np.uint8)
    for i, plane in enumerate(planes):
        bits[i] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), bitorder="little")[:n]
    return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes one file: ``add`` documents in order, then ``close``."""

    def __init__(self, sink, mode: str = "bit", block: int = BLOCK_IDS, level: int = 3):
        self.sink, self.mode, self.block = sink, mode, block
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._open: list[np.ndarray] = []
        self._waiting = 0
        self._at, self._chunks = 0, []
        self._docs: list[np.ndarray] = []
        self._lengths: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self._docs.append(np.asarray(doc_ids, dtype="<i8"))
        self._lengths.append(np.asarray(lengths, dtype="<i8"))
        self._open.append(ids)
        self._waiting += len(ids)
        if self._waiting >= self.block:
            self._flush(self._waiting - self._waiting % self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self._open)
        for lo in range(0, n, self.block):
            part = ids[lo : min(lo + self.block, n)]
            bits = max(1, int(part.max()).bit_length())
            planes = [self._zstd.compress(p.tobytes()) for p in split_planes(part, bits, self.mode)]
            self._chunks.append([self._at, len(part), [len(p) for p in planes]])
            for plane in planes:
                self.sink.write(plane)
                self._at += len(plane)
        self._open, self._waiting = [ids[n:]], len(ids) - n

    def close(self) -> int:
        """Writes the rest and the footer; returns the size of the file."""
        if self._waiting:
            self._flush(self._waiting)
        docs, lengths = (np.concatenate(x) if x else np.zeros(0, dtype="<i8") for x in (self._docs, self._lengths))
        head = json.dumps({"mode": self.mode, "block": self.block, "docs": len(docs), "chunks": self._chunks}).encode()
        footer = self._zstd.compress(struct.pack("<q", len(head)) + head + docs.tobytes() + lengths.tobytes())
        self.sink.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        return self._at + len(footer) + 16


class Reader:
    """Random access to one file by its chunk index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if bytes(tail[8:]) != MAGIC:
            raise ValueError("not a plane file")
        n = struct.unpack("<q", tail[:8])[0]
        self._zstd = zstandard.ZstdDecompressor()
        footer = self._zstd.decompress(source.read_at(n, size - 16 - n))
        h = struct.unpack("<q", footer[:8])[0]
        head = json.loads(footer[8 : 8 + h])
        self.mode, self.block, self.chunks = head["mode"], head["block"], head["chunks"]
        m = head["docs"]
        self.doc_ids = np.frombuffer(footer, dtype="<i8", count=m, offset=8 + h)
        self.lengths = np.frombuffer(footer, dtype="<i8", count=m, offset=8 + h + 8 * m)
        self.starts = np.append(0, np.cumsum(self.lengths))

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.chunks[k]
        raw = self.source.read_at(sum(sizes), at)
        planes, done = [], 0
        for size in sizes:
            planes.append(self._zstd.decompress(raw[done : done + size]))
            done += size
        return join_planes(planes, n, self.mode)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from the chunks that hold them."""
        lo, hi = int(self.starts[i]), int(self.starts[i + 1])
        if lo == hi:
            return np.zeros(0, dtype="<u4")
        first, last = lo // self.block, (hi - 1) // self.block
        return np.concatenate([self.chunk(k) for k in range(first, last + 1)])[lo - first * self.block : hi - first * self.block]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of all documents, with one chunk read at a time."""
        have, base, k = np.zeros(0, dtype="<u4"), 0, 0
        for i, doc in enumerate(self.doc_ids.tolist()):
            lo, hi = int(self.starts[i]), int(self.starts[i + 1])
            have, base = have[lo - base :], lo
            parts, n = [have], len(have)
            while n < hi - lo:
                parts.append(self.chunk(k))
                n += len(parts[-1])
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield doc, lo, have[: hi - lo]


#: Byte values between which a piece may end: an ASCII letter, then plain punctuation.
_LETTER = byte_mask([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_PLAIN = byte_mask(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class WordCodec:
    """The tokenizers library with its results kept by piece.

    The vocabulary lower-cases, drops white space and splits runs of letters from runs of
    punctuation. So a text's ids are those of its pieces between ASCII white space, and
    such a piece may be cut where an ASCII letter meets plain ASCII punctuation (not an
    apostrophe, which begins contractions, nor the characters of special tokens). In text
    without special tokens, pieces that differ in ASCII case only are one.
    """

    MOST_PIECES = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = PieceCache(self.MOST_PIECES)

    def encode(self, part: Slice, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id appended, and the rows' offsets."""
        raw = part.data.tobytes()
        if b"<|" not in raw:
            part = Slice(part.first, _LOWER[part.data], part.off)
            raw = part.data.tobytes()
        data = part.data
        words = part.words()
        letter, plain = _LETTER[data], _PLAIN[data]
        full = ~IS_SPACE[data]
        cut = np.flatnonzero(((letter[:-1] & plain[1:]) | (plain[:-1] & letter[1:])) & full[1:]) + 1 if len(data) else np.zeros(0, dtype=np.int64)
        borders = np.zeros(len(data) + 1, dtype=bool)
        borders[part.off] = True
        cut = cut[~borders[cut]]
        start, end = (merged(x, cut, len(data)) for x in (words.start, words.end))
        row = np.searchsorted(start, part.off)
        hashes = part.rolling().spans(start, end) ^ part.rolling(1).spans(start, end)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)

        def learn(new: np.ndarray) -> list[list[int]]:
            spans = zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)
            return [x.ids for x in self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in spans], add_special_tokens=False)]

        slots = self.cache.lookup(keys, learn)[inverse] if len(keys) else np.zeros(0, dtype=np.int32)
        # one more entry after each row's pieces: the end id
        at = np.arange(len(slots)) + np.repeat(np.arange(part.n), np.diff(row))
        ends = row[1:] + np.arange(part.n)
        begin, many = np.zeros(len(slots) + part.n, dtype=np.int64), np.ones(len(slots) + part.n, dtype=np.int64)
        begin[at], many[at] = self.cache.spans(slots)
        ids, before = self.cache.gather(begin, many)
        ids[before[ends]] = end_id
        return ids, np.append(0, before[ends] + 1)


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) with ids as zstandard-compressed little-endian 32-bit words.

    Null and empty texts have the end id alone; rows with a null doc_id have no place in
    the order and are left out; repeated rows are encoded each.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, zstd = word_codec(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch):
                ids, off = own.encode(part, end_id)
                wide = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
                raw = ids.astype(wide).tobytes()
                size = np.dtype(wide).itemsize
                blobs = [zstd.compress(raw[a * size : b * size]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(np.diff(off)), pa.array([size] * part.n, pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "width", "ids"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint, width int, ids binary")


def _open_input(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def write_files(encoded: DataFrame, folder: str, mode: str = "bit", block: int = BLOCK_IDS) -> DataFrame:
    """Writes ``encode_documents``' rows as files in ascending doc_id order.

    ``encoded`` must be range-partitioned and sorted by doc_id, as ``lay_out`` leaves it.
    Each task writes one file under a name of its own attempt, so a repeated task leaves
    its predecessor's file unreferenced instead of clashing with it. Returns the index:
    (path, part, first_doc, n_docs, n_ids).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{attempt}.planes"
        zstd, sink, writer = zstandard.ZstdDecompressor(), None, None
        first, n_docs, n_ids = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = Writer(sink, mode, block)
                first = batch.column(0)[0].as_py()
            width = batch.column(2).to_numpy()
            for lo in range(0, batch.num_rows, 500):
                ids = [np.frombuffer(zstd.decompress(blob.as_buffer()), dtype=np.uint16 if w == 2 else np.uint32).astype(np.uint32) for blob, w in zip(batch.column(3).slice(lo, 500), width[lo : lo + 500], strict=True)]
                lengths = np.array([len(x) for x in ids])
                writer.add(batch.column(0).slice(lo, 500).to_numpy(), lengths, np.concatenate(ids))
                n_ids += int(lengths.sum())
            n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "first_doc": [first], "n_docs": [n_docs], "n_ids": [n_ids]})

    return encoded.mapInArrow(run, "path string, part int, first_doc bigint, n_docs bigint, n_ids bigint")


def lay_out(encoded: DataFrame, file_ids: int = FILE_IDS) -> DataFrame:
    """The rows in ascending doc_id order over as many partitions as the ids need."""
    total = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    session = encoded.sparkSession
    parts = max(1, -(-int(total) // file_ids), min(int(session.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // (1 << 20))))
    return encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")


def read_files(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    Starts count the ids of all files before; the running sum is over the index only,
    one row a file.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = index.select("path", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open_input(path) as source:
                    rows = []
                    for doc, lo, ids in Reader(source).documents():
                        rows.append((doc, base + lo, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) >= 50_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    n = max(1, index.count())
    return placed.repartition(n, "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, vocabulary: str | None = None, mode: str = "bit") -> DataFrame:
    """Encodes docs, writes the plane files, reads them back.

    One row for each row of docs that has a doc_id; an empty table writes no file and
    gives no rows; rows with equal doc_id stand in the order of their lengths and ids.
    """
    spark = docs.sparkSession
    encoded = written(encode_documents(docs, vocabulary), "ids")
    index = written(write_files(lay_out(encoded), new_path(spark, "planes"), mode), "planes-index")
    return read_files(index)


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
