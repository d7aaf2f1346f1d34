"""Lexical retrieval packing with a sharded BM25 index.

Documents become token ids with an end id.  Each is keyed by the least hashes
of its ids and of its runs of three, so documents that share words come near;
one range exchange sorts them by key, then by a salt of their place in the
input, so a key that many documents share is split like any other range.  Each
task cuts its sorted run into shards of at most ``DOCS`` documents and about
``IDS`` ids, whatever the size of the data, and holds one shard at a time.
Terms are token ids, so the table of document frequencies over *all* documents
has at most one row for each id of the vocabulary, and that bounded table is
what each task receives.

In a shard, a window's seed is the document it starts with.  The index gives
the BM25 score of all the seed's terms for every document of the shard: terms
in few documents by their postings, the others by a dense product.  The seed's
neighbours that are not yet used, best score first, fill the window; what
doesn't fit is cut and opens the next window.  Without a neighbour left, the
next unused document in key order follows.  Windows go on from shard to shard,
so only a task's last window is not full.

Null text: empty, one end id.  Every row of docs, repeated ones too, is a
document of its own; equal scores go in key order.  Columns other than doc_id
and text are ignored.  No rows give no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.llm.tokens import default_path, encoder

WINDOW, K1, B = 1024, 1.2, 0.75
#: Most documents and about the most ids of a shard; documents from which on a term is scored by the dense product.
DOCS, IDS, DENSE = 1024, 1 << 20, 24
#: Bytes of ids that a task packs.
TASK = 32 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ENCODED = "doc_id long, key long, salt long, n long, ids binary, df array<long>"


def keys_of(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """15 bits of each document's least hash of an id, then 48 of its least hash of three in a row (of all its ids where fewer)."""
    h = hashes[ids]
    one = np.minimum.reduceat(h, starts)
    three = np.full(len(h), np.uint64(C.MASK))
    mult = np.uint64(C.MULT)
    if len(h) > 2:
        three[:-2] = C.mixed((h[:-2] * mult + h[1:-1]) * mult + h[2:])
    ends = starts + lengths
    for back in (1, 2):  # runs that would cross into the next document
        three[ends[lengths >= back] - back] = np.uint64(C.MASK)
    three = np.minimum.reduceat(three, starts)
    for size in (1, 2):
        at = starts[lengths == size]
        three[lengths == size] = C.mixed(h[at] if size == 1 else h[at] * mult + h[at + 1])
    return ((one >> np.uint64(49)) << np.uint64(48) | three >> np.uint64(16)).view(np.int64)


def terms_of(ids: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of all distinct pairs, sorted."""
    bits = max(1, (size - 1).bit_length())
    kind = np.uint32 if len(lengths).bit_length() + bits <= 32 else np.uint64
    both = np.sort(np.repeat(np.arange(len(lengths), dtype=kind) << kind(bits), lengths) | ids.astype(kind))
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    pair = both[first]
    return (pair >> kind(bits)).astype(np.int64), (pair & kind((1 << bits) - 1)).astype(np.int64), np.diff(np.append(first, len(both)))


def _encoded(tokenizer, end_id):
    def run(batches):
        df, row, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            coder = encoder(tokenizer, 450_000)
            size = max(coder.size, end_id + 1)
            if df is None:
                df, hashes = np.zeros(size, np.int64), C.mixed(np.arange(1, size + 1, dtype=np.uint64))
            end = np.array([end_id], coder.dtype).tobytes()
            blobs = [coder.encode(text.as_py()) + end for text in batch.column(1)]
            sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
            ids = np.frombuffer(b"".join(blobs), coder.dtype)
            lengths = sizes // coder.dtype.itemsize
            df += np.bincount(terms_of(ids, lengths, size)[1], minlength=size)
            keys = keys_of(ids, np.cumsum(lengths) - lengths, lengths, hashes)
            salt = C.mixed(np.arange(row, row + len(blobs), dtype=np.uint64) + np.uint64(part << 40)).view(np.int64)
            row += len(blobs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(salt), pa.array(lengths), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.list_(pa.int64()))], names=["doc_id", "key", "salt", "n", "ids", "df"])
        if df is not None:
            nulls = [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([df.tolist()], pa.list_(pa.int64()))], names=["doc_id", "key", "salt", "n", "ids", "df"])

    return run


class Index:
    """BM25 of every document of a shard for the terms of every other."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float):
        n = len(lengths)
        doc, term, tf = terms_of(ids, lengths, len(idf))
        often = np.bincount(term, minlength=len(idf))
        keep = often[term] > 1
        doc, term, tf = doc[keep], term[keep], tf[keep].astype(np.float32)
        size = lengths.astype(np.float32)[doc]
        weight = idf[term] * (tf * np.float32(K1 + 1) / (tf + np.float32(K1 * (1 - B)) + np.float32(K1 * B / mean) * size))
        dense = often[term] >= DENSE
        column = np.cumsum(often >= DENSE) - 1
        held = np.zeros((2, n, int((often >= DENSE).sum())), np.float32)
        held[0, doc[dense], column[term[dense]]] = 1
        held[1, doc[dense], column[term[dense]]] = weight[dense]
        self.scores = held[0] @ held[1].T
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        doc, term, weight = doc[order], term[order], weight[order]
        n_of = often[term]
        first = np.searchsorted(term, term)
        left = np.repeat(np.arange(len(term)), n_of)  # each posting with all of its term
        right = np.repeat(first - (np.cumsum(n_of) - n_of), n_of) + np.arange(len(left))
        if len(left):
            self.scores += np.bincount(doc[left] * n + doc[right], weight[right], n * n).reshape(n, n).astype(np.float32)

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Scores of the documents for the seed's terms; 0 for those used and those that share none."""
        return np.where(used, np.float32(0), self.scores[seed])


def packed_order(ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float, window: int = WINDOW, at: int = 0) -> list[int]:
    """The shard's documents in the order in which they fill windows; at: ids that stand before them."""
    index, used, order = Index(ids, lengths, idf, mean), np.zeros(len(lengths), bool), []
    sizes, near, following, opened = lengths.tolist(), None, 0, at // window
    for _ in sizes:
        if at % window == 0:  # the next document opens a window
            near, opened = None, at // window
        elif at // window != opened:  # the document before was cut, and is the seed of this window
            near, opened = index.neighbours(order[-1], used), at // window
        pick = int(near.argmax()) if near is not None else -1
        if pick < 0 or near[pick] <= 0:
            while used[following]:
                following += 1
            pick = following
        seed = at % window == 0
        used[pick] = True
        order.append(pick)
        at += sizes[pick]
        if seed and at // window == opened:
            near = index.neighbours(pick, used)
        elif near is not None:
            near[pick] = 0
    return order


def _pieces(ids, lengths, doc_ids, order, at, window, part, with_ids):
    """The ordered documents cut at the windows' ends."""
    starts = np.cumsum(lengths) - lengths
    size = lengths[order]
    ends = np.cumsum(size) + at
    begins = ends - size
    cuts = np.unique(np.concatenate([begins, np.arange(-(-at // window) * window, ends[-1], window)]))
    cuts = cuts[(cuts >= at) & (cuts < ends[-1])]
    which = np.searchsorted(ends, cuts, "right")
    length = np.diff(np.append(cuts, ends[-1]))
    stream = np.concatenate([ids[s : s + n] for s, n in zip(starts[order].tolist(), size.tolist(), strict=True)])
    raw = memoryview(stream.astype("<u4").tobytes())
    bounds = (4 * (cuts - at)).tolist()
    crcs = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, [*bounds[1:], len(raw)], strict=True)]
    own = pa.array([doc_ids[order[w]] for w in which.tolist()], pa.int64())
    found = [own, *map(pa.array, (cuts - begins[which], length, np.array(crcs, np.int64), size[which], (part << 40) + cuts // window, cuts % window))]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        found.append(pa.ListArray.from_arrays(pa.array(np.append(cuts - at, len(stream)), pa.int32()), pa.array(stream.astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(found, names=names)


def _packed(idf, mean, window, dtype, with_ids, most, size_most):
    def run(batches):
        part, at, total, doc_ids, blobs = TaskContext.get().partitionId(), 0, 0, [], []

        def shard():
            ids = np.frombuffer(b"".join(blobs), dtype)
            lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // dtype.itemsize
            order = np.array(packed_order(ids, lengths, idf, mean, window, at))
            return _pieces(ids, lengths, doc_ids, order, at, window, part, with_ids), len(ids)

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                blobs.append(blob)
                total += len(blob)
                if len(blobs) >= most or total >= size_most * dtype.itemsize:
                    found, size = shard()
                    yield found
                    at, total, doc_ids, blobs = at + size, 0, [], []
        if blobs:
            yield shard()[0]

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all rows of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, the ids."""
    tokenizer = tokenizer or default_path()
    coder = encoder(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = C.written(C.mapped(rows, _encoded(tokenizer, end_id), ENCODED), "encoded")
    texts = encoded.where("ids IS NOT NULL")
    said = texts.agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).first()
    counts = encoded.where("df IS NOT NULL").select(F.posexplode("df").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most one row for each id of the vocabulary
    df = np.zeros(max(coder.size, end_id + 1))
    for r in counts:
        df[r["term"]] = r["n"]
    idf = np.log1p((said["docs"] - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = (said["ids"] or 0) / max(1, said["docs"])
    parts = C.parts(docs.sparkSession, (said["ids"] or 0) * coder.dtype.itemsize, TASK)
    placed = texts.repartitionByRange(parts, "key", "salt").sortWithinPartitions("key", "salt").select("doc_id", "ids")
    return C.mapped(placed, _packed(idf, max(mean, 1.0), window, coder.dtype, with_ids, DOCS, IDS), SCHEMA + (", ids array<int>" if with_ids else ""))
