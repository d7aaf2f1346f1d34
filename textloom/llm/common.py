"""What the operators share: words, rolling hashes, packed rows and written tables.

Large exchanges move *packed* rows ``(k int, v binary)``: a map task deals its
entries to ``n`` buckets and sends one binary block to each, so the JVM handles
a few large rows instead of one row per word.  ``n`` follows the input's size in
bytes, so a bucket's size does not depend on the size of the data.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "k int, v binary"
ROWS_A_BATCH = 1500
#: Bytes of compressed input in a bucket.
BUCKET = 16 << 20
#: Stands for a null doc_id while rows are ordered; null ids come last.
NO_ID = np.iinfo(np.int64).max
MULT = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def parts(spark: SparkSession, size: int, each: int) -> int:
    """Tasks of about ``each`` bytes for ``size`` bytes, and as many as the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // each), 1)


def buckets(df: DataFrame, each: int = BUCKET) -> int:
    """Buckets of about ``each`` bytes by the optimizer's size of df; rows whose size it doesn't know get the session's shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return parts(df.sparkSession, size if size < 1 << 60 else 0, each)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    context = spark.sparkContext
    if (path := context.getCheckpointDir()) is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        path = context.getCheckpointDir()
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a table in the shared folder, which survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS_A_BATCH rows where the session still has Spark's default of 10,000: a worker holds whole batches of texts."""
    if (key := "spark.sql.execution.arrow.maxRecordsPerBatch") and spark.conf.get(key) == "10000":
        spark.conf.set(key, ROWS_A_BATCH)


def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; a task's end gives freed memory back to the system, as its worker lives on beside others."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with small batches, tidied."""
    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: tidied(run(batches)), schema)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and the text's bytes; nothing else leaves the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def filtered(docs: DataFrame, judge) -> DataFrame:
    """The rows of docs, with all their columns, whose texts ``judge()`` (made once a task) accepts; no exchange."""
    place = docs.columns.index("text")

    def run(batches):
        accepts = judge()
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(accepts(texts), pa.bool_()))

    return mapped(docs, run, docs.schema)


def columns(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def ids_and_texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list]:
    ids, texts = columns(batch, "doc_id", "text")
    return ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), texts.to_pylist()


def packed(keys: Iterable[int], blobs: Iterable[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["k", "v"])


def dealt(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One block of each bucket's rows, in their order."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate(([0], cuts)).astype(int) if len(bucket) else np.zeros(0, int)
    return packed([int(bucket[s]) for s in starts], [x.tobytes() for x in np.split(rows, cuts)] if len(bucket) else [])


def gathered(batches: Iterable[pa.RecordBatch], dtype) -> np.ndarray:
    """All rows of packed blocks of one kind."""
    parts = [np.frombuffer(v, dtype) for b in batches for v in b.column(1).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def squeezed(ids: np.ndarray, texts: list) -> bytes:
    """Documents as one compressed block; None stays None."""
    sizes = np.array([-1 if t is None else len(t) for t in texts], np.int64)
    head = np.array([len(ids)], np.int64).tobytes() + ids.astype(np.int64).tobytes() + sizes.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(t for t in texts if t))


def unsqueezed(block: bytes) -> tuple[np.ndarray, list]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    texts, at = [], 8 + 16 * n
    for size in sizes.tolist():
        texts.append(None if size < 0 else raw[at : at + size])
        at += max(size, 0)
    return ids, texts


class WordHashes(dict):
    """64-bit hash of each word; forgets all when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_WORD_HASHES = WordHashes()


def word_hashes() -> WordHashes:
    """This process's table of word hashes: workers are used again, and keep it."""
    return _WORD_HASHES


def hashed_words(texts: Iterable, cache: WordHashes) -> Iterator[np.ndarray]:
    """Word hashes of each text. bytes.split() parts at exactly x20 and x09-x0D."""
    for text in texts:
        words = text.split() if text else ()
        yield np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Polynomial hashes of all n-grams of a word stream, built by doubling."""

    def __init__(self, words: np.ndarray):
        self.of = {1: words}

    def raw(self, n: int) -> np.ndarray:
        if n not in self.of:
            a = 1 << (n.bit_length() - 1)
            a = a // 2 if a == n else a
            left, right = self.raw(a), self.raw(n - a)
            size = max(0, len(self.of[1]) - n + 1)
            self.of[n] = left[:size] * np.uint64(pow(MULT, n - a, 1 << 64)) + right[a : a + size]
        return self.of[n]

    def __call__(self, n: int) -> np.ndarray:
        return mixed(self.raw(n))


def sliding(h: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every ``width`` neighbours."""
    size, reach = len(h) - width + 1, 1
    if size <= 0:
        return h[:0]
    while 2 * reach <= width:
        h, reach = best(h[:-reach], h[reach:]), 2 * reach
    return best(h[:size], h[width - reach : width - reach + size])


def isin_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values
