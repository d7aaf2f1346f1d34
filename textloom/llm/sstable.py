"""Sorted-string-table shards of token ids.

A shard is one file of a range of doc_ids, in order::

    "SST1"  block*  index  Bloom filter  footer

A block is a zstd frame of entries ``shared, unshared, value size`` (varints),
the key's unshared end, and the ids; keys share prefixes with the one before
and start afresh in each block.  A key is one byte (1: null doc_id), eight
bytes of doc_id in sort order, and four that number rows of the same doc_id.
The index is sparse: a block's first key, place and size.  The footer has the
places of index and filter, the number of documents and ids, the id width and
a checksum of index and filter.  ``Table.get`` asks the filter, finds the block
by binary search, and reads that block only.

Files go to ``out_dir`` by any filesystem that pyarrow knows from the URI.
Each task attempt writes its own file; the table of files names the ones that
count, so a lost executor or a second attempt leaves no wrong row.  Null text:
no ids but the end id.  Rows that repeat a doc_id are stored each, by a hash of
the text; many of them may go on in the next file.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.llm.tokens import default_path, encoder

MAGIC, BLOCK, BITS_A_KEY, PROBES = b"SST1", 1 << 16, 10, 7
FOOTER = struct.Struct("<QQQQQQIB3x4s")
FILES = "part int, path string, n_docs long, n_ids long"
SCHEMA = "doc_id long, local_start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None, row: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is None, 0 if doc_id is None else doc_id + (1 << 63), row)


def id_of(key: bytes) -> int | None:
    null, number, _ = struct.unpack(">BQI", key)
    return None if null else number - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n, at, shift = n | (byte & 127) << shift, at + 1, shift + 7
        if byte < 128:
            return n, at


def _probes(key: bytes, bits: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest(key[:9])
    return np.array([(h + i * (h >> 32 | 1)) % bits for i in range(PROBES)], np.int64)


class Writer:
    def __init__(self, file, width: int):
        self.file, self.width = file, width
        self.at, self.block, self.first, self.last = 0, bytearray(), b"", b""
        self.index, self.keys, self.n_ids = [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        """Keys must rise."""
        if not self.block:
            self.first, self.last = key, b""
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = zstandard.ZstdCompressor(level=1, write_checksum=True).compress(bytes(self.block))
            self.index.append((self.first, self.at, len(data)))
            self._put(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        bits = max(64, len(self.keys) * BITS_A_KEY)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        index_at = self.at
        self._put(index)
        bloom_at = self.at
        self._put(bloom)
        self._put(FOOTER.pack(index_at, len(index), bloom_at, bits, len(self.keys), self.n_ids, zlib.crc32(index + bloom), self.width, MAGIC))
        self.file.close()


class Table:
    """A shard, opened: footer, index and filter are in memory, blocks are read when asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        index_at, index_size, bloom_at, self.bits, self.n_docs, self.n_ids, crc, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        index, bloom = self._read(index_at, index_size), self._read(bloom_at, size - FOOTER.size - bloom_at)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError("not a whole shard")
        self.dtype = np.dtype(f"<u{self.width}")
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8), bitorder="little")
        self.index, at = [], 0
        while at < len(index):
            n = index[at]
            self.index.append((index[at + 1 : at + 1 + n], *struct.unpack_from("<QQ", index, at + 1 + n)))
            at += 17 + n

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size = self.index[block]
        data, key, at = zstandard.ZstdDecompressor().decompress(self._read(at, size)), b"", 0
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.index)):
            for key, ids in self._entries(block):
                yield id_of(key), np.frombuffer(ids, self.dtype)

    def get(self, doc_id: int | None, row: int = 0) -> np.ndarray | None:
        key = key_of(doc_id, row)
        if not self.bloom[_probes(key, self.bits)].all():
            return None
        block = bisect.bisect_right(self.index, key, key=lambda x: x[0]) - 1
        if block < 0:
            return None
        return next((np.frombuffer(ids, self.dtype) for k, ids in self._entries(block) if k == key), None)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, out_dir: str, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards; returns the table of files: part, path, n_docs and n_ids."""
    tokenizer = tokenizer or default_path()

    def run(batches):
        store, root = _filesystem(out_dir)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        path = f"{root}/{part:06d}-{uuid.uuid4().hex}.sst"
        writer = None
        last, row = b"", 0
        for batch in batches:
            coder = encoder(tokenizer, 600_000)
            writer = writer or Writer(store.open_output_stream(path, compression=None), coder.dtype.itemsize)
            end = np.array([end_id], coder.dtype).tobytes()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = row + 1 if last == key_of(doc_id) else 0
                last = key_of(doc_id)
                writer.add(key_of(doc_id, row), coder.encode(text.as_py()) + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(writer.keys)], "n_ids": [writer.n_ids]})

    order = F.col("doc_id").asc_nulls_last()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("mix", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())  # ``at`` parts rows that are equal, so it may change
    placed = rows.repartitionByRange(C.buckets(docs), order, "mix", "at").sortWithinPartitions(order, "mix", "at").drop("mix", "at")
    return C.written(C.mapped(placed, run, FILES), "shard-files")


def read_shards(files: DataFrame, out_dir: str) -> DataFrame:
    """doc_id, local_start (ids before it in its file), n_tokens and ids_crc32, from the files' own bytes."""

    def run(batches):
        store, _ = _filesystem(out_dir)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out, at = [], start
                with store.open_input_file(path) as file:
                    for doc_id, ids in Table(file).scan():
                        out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part")  # one row a file
    places = files.withColumn("start", F.sum("n_ids").over(before) - F.col("n_ids"))
    n = C.parts(files.sparkSession, 0, 1)
    return places.select("path", "start", "part").repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int")).select("path", "start").mapInArrow(run, SCHEMA.replace("local_start", "start"))


def token_table(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, out_dir: str | None = None) -> DataFrame:
    """Writes shards and reads them back: doc_id, start, n_tokens and ids_crc32."""
    out_dir = out_dir or f"{C.shared_dir(docs.sparkSession)}/sst-{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, out_dir, end_id, tokenizer), out_dir)
