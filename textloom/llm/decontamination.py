"""Benchmark decontamination by spaced seeds.

A mask fixes some token positions and ignores those between.  Test items and
training documents are hashed under each mask at every position; equal hashes
are hits, and around each hit the item is compared with the hit's document,
place by place: a document is contaminated by an item when some window of
``WINDOW`` tokens of the item, or the whole of a shorter one, agrees with the
document in at least ``SHARE`` of its places.  ``FAMILIES`` gives the masks for
each length of item: however the substitutions that SHARE allows fall, one of
its masks stays whole somewhere in the window, so every such overlap is found.
Items of one to four tokens allow no substitution: their mask is the item.
Tokens are words without case or outer punctuation.

Items go to the tasks in parts of about ``PART`` words each; a benchmark larger
than one part makes further scans, one part at a time, never a larger broadcast.
Documents are not exchanged at all.  Hits are expanded ``AT_ONCE`` at a time, so
neither a hot seed nor a long item makes a large array.

Null or empty texts match nothing.  Rows of items with a null item_id are items
like any other.  Repeated items and documents each give their rows.  Of several
alignments of a pair, the row tells the one with the most matches in a window,
then the most equal tokens over the whole alignment, then the first start.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.llm.substring_dedup import CHUNK

WINDOW, PART, AT_ONCE = 15, 400_000, 1 << 17
#: A window agrees if SHARE = 4 / 5 of its places do.
SHARE = (4, 5)
#: Least and most tokens of an item, and the masks for it.
FAMILIES = (
    (1, 1, ((0,),)),
    (2, 2, ((0, 1),)),
    (3, 3, ((0, 1, 2),)),
    (4, 4, ((0, 1, 2, 3),)),
    (5, 9, ((0, 1, 2), (0, 1, 4))),
    (10, 12, ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))),
    (13, 1 << 60, ((0, 1, 4, 7, 9, 10), (0, 1, 2, 4, 5, 6), (0, 1, 7, 8, 9, 10))),
)
MASKS = [(least, most, mask) for least, most, masks in FAMILIES for mask in masks]
OUTER = b"\"'`.,;:!?()[]{}<>*#%$&|-_"
SCHEMA = "doc_id long, item_id long, start long, matched int, window int, overlap int"


class Tokens(C.WordHashes):
    """Hash of a word without case and outer punctuation; of the bare word if nothing else is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        bare = word.decode("utf-8", "replace").lower().encode().strip(OUTER) or word
        found = self[word] = xxhash.xxh64_intdigest(bare)
        return found


def _seeds(tokens: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash under the mask at each position where its span fits."""
    size = len(tokens) - mask[-1]
    h = np.full(max(size, 0), np.uint64(number + 1))
    for j in mask:
        h = h * np.uint64(C.MULT) + tokens[j : j + size] if size > 0 else h
    return C.mixed(h)


class Items:
    """Seeds of one part of the benchmark, sorted, behind a bit filter."""

    def __init__(self, ids: list[int | None], texts: list):
        tokens = list(C.hashed_words(texts, Tokens()))
        keep = [i for i, t in enumerate(tokens) if len(t)]
        self.ids, tokens = [ids[i] for i in keep], [tokens[i] for i in keep]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.concatenate([*tokens, np.zeros(1, np.uint64)])
        self.masks, parts = [], []
        for k, (least, most, mask) in enumerate(MASKS):
            own = [(h := _seeds(t, mask, k), np.full(len(h), i), np.arange(len(h))) for i, t in enumerate(tokens) if least <= len(t) <= most]
            if own:
                self.masks.append((k, mask))
                parts += own
        h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order].astype(np.uint64), item[order], at[order]
        self.bits = max(16, int(len(h)).bit_length() + 4)
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.h >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, doc_of: np.ndarray):
        """(item, place in the item, place in the words) of seeds that are equal, some AT_ONCE at a time."""
        for k, mask in self.masks:
            h = _seeds(words, mask, k)
            p = np.flatnonzero(self.filter[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            p = p[doc_of[p] == doc_of[p + mask[-1]]]
            low, high = np.searchsorted(self.h, h[p], "left"), np.searchsorted(self.h, h[p], "right")
            some = np.flatnonzero(high > low)
            p, low, n = p[some], low[some], (high - low)[some]
            group = np.cumsum(n) // AT_ONCE
            for cut in np.split(np.arange(len(p)), np.flatnonzero(np.diff(group)) + 1) if len(p) else ():
                m = n[cut]
                place = np.repeat(low[cut] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                yield self.item[place], self.at[place], np.repeat(p[cut], m)


def _verified(items: Items, words, lengths):
    """(document, item, start in words, matched) of each hit with a window around it that agrees."""
    begin = np.cumsum(lengths) - lengths
    doc_of = np.repeat(np.arange(len(lengths)), lengths)
    near = np.arange(1 - WINDOW, WINDOW)  # a window that holds the seed lies in this reach
    for all_item, all_at, all_p in items.hits(words, doc_of):
        for cut in range(0, len(all_item), AT_ONCE):
            item, at, p = (x[cut : cut + AT_ONCE] for x in (all_item, all_at, all_p))
            own = doc_of[p]
            inside, place = at[:, None] + near, p[:, None] + near
            ok = (inside >= 0) & (inside < items.sizes[item][:, None]) & (place >= begin[own][:, None]) & (place < (begin + lengths)[own][:, None])
            same = ok & (words[np.where(ok, place, 0)] == items.tokens[np.where(ok, items.starts[item][:, None] + inside, 0)])
            total = np.concatenate([np.zeros((len(item), 1), np.int16), np.cumsum(same, 1, dtype=np.int16)], 1)
            matched = (total[:, WINDOW:] - total[:, :-WINDOW]).max(1)
            good = np.flatnonzero(SHARE[1] * matched >= SHARE[0] * np.minimum(WINDOW, items.sizes[item]))
            if len(good):
                yield own[good], item[good], (p - at)[good], matched[good]


def _best(items: Items, words, lengths) -> list[tuple]:
    """(document, item id, start, matched, window, overlap), a row a document and item."""
    parts = list(_verified(items, words, lengths))
    if not parts:
        return []
    doc, item, start, matched = (np.concatenate(x) for x in zip(*parts, strict=True))
    begin = np.cumsum(lengths) - lengths
    order = np.lexsort((start, -matched, item, doc))
    doc, item, start, matched = doc[order], item[order], start[order], matched[order]
    pair = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
    most = matched[pair][np.cumsum(pair) - 1]
    keep = (matched == most) & np.concatenate(([True], pair[1:] | (start[1:] != start[:-1])))
    best = {}
    for d, i, s, m in zip(*(x[keep].tolist() for x in (doc, item, start, matched)), strict=True):
        a, b = max(s, begin[d]), min(s + items.sizes[i], begin[d] + lengths[d])
        shift = items.starts[i] - s
        overlap = int((words[a:b] == items.tokens[a + shift : b + shift]).sum())
        row = (-overlap, max(s - int(begin[d]), 0), m)
        best[d, i] = min(best.get((d, i), row), row)
    return [(d, items.ids[i], s, m, int(min(WINDOW, items.sizes[i])), -o) for (d, i), (o, s, m) in best.items()]


def _streams(texts: list, cache: Tokens):
    """Word streams of about CHUNK words: words, lengths, and the place of the first text."""
    part, first, size = [], 0, 0
    for i, h in enumerate(C.hashed_words(texts, cache)):
        part.append(h)
        size += len(h)
        if size >= CHUNK:
            yield np.concatenate(part), np.array([len(x) for x in part]), first
            part, first, size = [], i + 1, 0
    if part:
        yield np.concatenate(part), np.array([len(x) for x in part]), first


def _matches(items):
    def run(batches):
        cache = Tokens()
        for batch in batches:
            ids = batch.column(0)
            for words, lengths, first in _streams(batch.column(1).to_pylist(), cache):
                if rows := _best(items, words, lengths):
                    where, *rest = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([first + d for d in where])), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], names=["doc_id", "item_id", "start", "matched", "window", "overlap"])

    return run


def _parts(benchmark: DataFrame):
    """Number of parts, and a generator of the benchmark's items, about PART words at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // (6 * PART)) + 1

    def each():
        for part in range(parts):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # about PART words
            yield Items([r["item_id"] for r in rows], [bytes(r["text"]) for r in rows])

    return parts, each()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and item row that overlap: the best window's matches and the equal tokens of the whole alignment."""
    parts, each = _parts(benchmark)
    found = (C.mapped(C.texts_of(docs), _matches(items), SCHEMA) for items in each)
    return reduce(DataFrame.unionAll, (f if parts == 1 else C.written(f, "contaminated") for f in found))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates."""

    def judge_by(items):
        def judge():
            cache = Tokens()

            def accepts(texts):
                ok = np.ones(len(texts), bool)
                for words, lengths, first in _streams(texts, cache):
                    for doc, *_ in _verified(items, words, lengths):
                        ok[first + doc] = False
                return ok

            return accepts

        return judge

    parts, each = _parts(benchmark)
    for items in each:
        docs = C.filtered(docs, judge_by(items))
        docs = docs if parts == 1 else C.written(docs, "clean")
    return docs
