"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words.  Each word covered by a window whose
word sequence also starts earlier (smaller doc_id, or earlier in the same
document) is removed.  Three narrow passes over the texts, in buckets of
consecutive doc_ids, and two exchanges of hashes:

1. Every window elects an *anchor*, the phrase of ``PHRASE`` words in it whose
   hash is least.  Equal windows elect equal anchors, so only windows whose
   anchor occurs twice can recur; about one word in five is an anchor.
2. Hashes of the windows left are exchanged once per bucket.  As buckets are
   ranges of doc_id, the lowest bucket that holds a window holds its first
   occurrence, so bare hashes confirm recurring windows and their first place.
3. In each bucket, confirmed passages are cut into tiles of ``TILE`` words,
   compiled into sharded Aho-Corasick automata over word numbers, and all its
   documents stream through them.  Windows around a hit are compared word by
   word with the bucket's first of their hash before they count.

A passage in a third of all documents costs each bucket one hash, so no task
sees more than its own documents and its share of distinct hashes.

Null or empty text: no words, nothing removed.  Rows with the same doc_id and
start are the same place: neither removes the other.  Null doc_ids come last.
Columns other than doc_id and text are ignored here.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

WINDOW, PHRASE, TILE = 20, 12, 10
#: Tiles in one automaton; more make further automata.  Letters of 7 bits for a word number.
SHARD, DIGITS = 100_000, 4
#: Words hashed at once, anchors sent at once; bytes of text sent at once.
CHUNK, BLOCK = 400_000, 16_000_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, text_hash long, kept_text string, spans array<struct<start:int,length:int>>"


def _streams(ids, texts, cache):
    """Word streams of about CHUNK words: (hashes, document of each word's index, lengths, first index)."""
    part, size, first = [], 0, 0
    for i, h in enumerate(C.hashed_words(texts, cache)):
        part.append(h)
        size += len(h)
        if size >= CHUNK:
            yield np.concatenate(part), np.array([len(x) for x in part]), first
            part, size, first = [], 0, i + 1
    if part:
        yield np.concatenate(part), np.array([len(x) for x in part]), first


def _windows(words, lengths):
    """anchor value of each window, which windows lie in one document, and the anchors' places."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return None
    roll = C.Rolling(words)
    phrase = roll(PHRASE)
    least = C.sliding(phrase, WINDOW - PHRASE + 1, np.minimum)
    ends = np.repeat(np.cumsum(lengths), lengths)
    valid = np.arange(WINDOW, n + WINDOW) <= ends[:n]
    return roll, phrase, least, valid


def _anchors(phrase, least, valid):
    reach = WINDOW - PHRASE
    pad = np.zeros(reach, np.uint64)
    return phrase == C.sliding(np.concatenate((pad, np.where(valid, least, np.uint64(0)), pad)), reach + 1, np.maximum)


def _bucket_of(ids, bounds):
    return np.searchsorted(bounds, ids, side="left").astype(np.int32)


ANCHOR = np.dtype([("h", "<u8"), ("b", "<u4")])


def _send_anchors(bounds, n):
    def block(found):
        rows = np.concatenate(found)
        rows = rows[np.argsort(rows["h"], kind="stable")]
        third = np.zeros(len(rows), bool)  # of equal rows two say as much as more
        third[2:] = rows[2:] == rows[:-2]
        rows = rows[~third]
        return C.dealt(((rows["h"] >> np.uint64(33)) % np.uint64(n)).astype(np.int32), rows)

    def run(batches):
        cache, found = C.word_hashes(), []
        for batch in batches:
            ids, texts = C.ids_and_texts(batch)
            for words, lengths, first in _streams(ids, texts, cache):
                if (w := _windows(words, lengths)) is None:
                    continue
                _, phrase, least, valid = w
                at = np.flatnonzero(_anchors(phrase, least, valid))
                home = np.repeat(_bucket_of(ids[first : first + len(lengths)], bounds), lengths)[at]
                rows = np.empty(len(at), ANCHOR)
                rows["h"], rows["b"] = phrase[at], home
                found.append(rows)
            if sum(map(len, found)) >= CHUNK:
                yield block(found)
                found = []
        if found:
            yield block(found)

    return run


def _recurring_anchors(batches):
    """To each bucket, its anchors that occur at least twice anywhere."""
    rows = C.gathered(batches, ANCHOR)
    rows = rows[np.argsort(rows["h"], kind="stable")]
    same = rows["h"][1:] == rows["h"][:-1]
    often = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(rows) else np.zeros(0, bool)
    rows = np.unique(rows[often])
    if len(rows):
        yield C.dealt(rows["b"].astype(np.int32), rows["h"])


def _send_texts(bounds):
    def blocks(ids, texts):
        ids = np.concatenate(ids)
        home = _bucket_of(ids, bounds)
        for k in np.unique(home).tolist():
            at = np.flatnonzero(home == k)
            yield C.packed([k], [b"T" + C.squeezed(ids[at], [texts[i] for i in at.tolist()])])

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            i, t = C.ids_and_texts(batch)
            ids.append(i)
            texts += t
            size += batch.nbytes
            if size >= BLOCK:
                yield from blocks(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield from blocks(ids, texts)

    return run


def _tagged(tag):
    def run(batches):
        for batch in batches:
            yield C.packed(batch.column(0), [tag + v for v in batch.column(1).to_pylist()])

    return run


def _received(batches):
    """The documents of a bucket in order, and the hashes sent to it by tag."""
    ids, texts, sent, key = [], [], {}, None
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = k
            if v[:1] == b"T":
                i, t = C.unsqueezed(v[1:])
                ids.append(i)
                texts += t
            else:
                sent.setdefault(v[:1], []).append(np.frombuffer(v, np.uint64, offset=1))
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    return key, ids[order], [texts[i] for i in order.tolist()], {k: np.sort(np.concatenate(v)) for k, v in sent.items()}


def _send_windows(n):
    """Distinct hashes of windows that may recur, with this bucket's number; twice if the bucket holds two or more."""

    def run(batches):
        key, ids, texts, sent = _received(batches)
        anchors, found, cache = sent.get(b"A", np.zeros(0, np.uint64)), [], C.word_hashes()
        for words, lengths, first in _streams(ids, texts, cache):
            if (w := _windows(words, lengths)) is None:
                continue
            roll, _, least, valid = w
            maybe = np.flatnonzero(valid)
            maybe = maybe[C.isin_sorted(least[maybe], anchors)]
            place = np.repeat(np.stack([ids[first : first + len(lengths)], np.cumsum(lengths) - lengths], 1), lengths, 0)[maybe]
            found.append((C.mixed(roll.raw(WINDOW)[maybe]), place[:, 0], maybe - place[:, 1]))
        if found:
            h, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((start, doc, h))
            h, doc, start = h[order], doc[order], start[order]
            again = np.zeros(len(h), bool)  # the same place twice counts once
            again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
            h = h[~again]
            third = np.zeros(len(h), bool)
            third[2:] = h[2:] == h[:-2]
            out = np.empty(int((~third).sum()), ANCHOR)
            out["h"], out["b"] = h[~third], key
            yield C.dealt(((out["h"] >> np.uint64(33)) % np.uint64(n)).astype(np.int32), out)

    return run


def _confirmed_windows(batches):
    """To each bucket, its recurring windows: F where it is the lowest that holds one, else L."""
    rows = C.gathered(batches, ANCHOR)
    rows = rows[np.lexsort((rows["b"], rows["h"]))]
    if not len(rows):
        return
    new = np.concatenate(([True], rows["h"][1:] != rows["h"][:-1]))
    size = np.diff(np.append(np.flatnonzero(new), len(rows)))
    often = np.repeat(size > 1, size)
    distinct = np.concatenate(([True], rows[1:] != rows[:-1]))
    for tag, keep in ((b"F", often & new), (b"L", often & ~new & distinct)):
        least = np.repeat(rows["b"][new], size)
        keep = keep if tag == b"F" else keep & (rows["b"] != least)
        if keep.any():
            yield from _tagged(tag)([C.dealt(rows["b"][keep].astype(np.int32), rows["h"][keep])])


def _letters(numbers: np.ndarray) -> np.ndarray:
    """Word numbers as DIGITS letters each, of another alphabet at each place: no node has many children, and matches keep to words."""
    places = np.arange(DIGITS, dtype=np.uint32)
    return ((numbers[:, None].astype(np.uint32) >> (7 * places)) & 127) + ((places + 1) << 8)


def _text(letters: np.ndarray) -> str:
    return letters.astype("<u4").tobytes().decode("utf-32-le")


def _automata(letters, tiles):
    """Automata over word numbers; a tile's value is its place in the stream."""
    for at in range(0, len(tiles), SHARD):
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in tiles[at : at + SHARD].tolist():
            machine.add_word(_text(letters[p : p + TILE]), p)
        machine.make_automaton()
        yield machine


def _located(numbers, starts, lengths, recurring):
    """Windows that equal a recurring one, by streaming all documents through the automata.

    recurring: places of the windows whose hash is confirmed, and the hashes.
    The first window of each hash is part of a passage; tiles of all passages
    make the dictionary.  A window is compared word by word with the first of
    its hash when a tile is hit inside it, and every window holds a whole tile
    of the passage that it belongs to.  Returns, for each window found, the
    place of that first window, else -1.
    """
    at, hashes = recurring
    n = max(len(numbers) - WINDOW + 1, 0)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    passage = np.zeros(n + 2, np.int8)
    passage[at[first] + 1] = 1
    edges = np.flatnonzero(np.diff(passage))
    tiles = np.concatenate([np.arange(a, b + WINDOW - TILE, TILE) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
    hit = np.zeros(len(numbers) + 1, np.int32)
    letters = _letters(numbers)
    for machine in _automata(letters, tiles):
        for s, size in zip(starts.tolist(), lengths.tolist(), strict=True):
            if size >= WINDOW and (ends := [end for end, _ in machine.iter(_text(letters[s : s + size]))]):
                hit[np.array(ends) // DIGITS + (s - TILE + 1)] = 1
    inside = np.concatenate(([0], np.cumsum(hit)))  # windows from p - 10 to p hold a tile at p
    held = inside[at + WINDOW - TILE + 1] > inside[at]
    at, ref = at[held], at[first][which[held]]
    refers, span = np.full(n, -1, np.int64), np.arange(WINDOW)
    for cut in range(0, len(at), 100_000):
        w, v = at[cut : cut + 100_000], ref[cut : cut + 100_000]
        same = (numbers[w[:, None] + span] == numbers[v[:, None] + span]).all(1)
        refers[w[same]] = v[same]
    return refers


def _cleaned(with_text):
    def run(batches):
        key, ids, texts, sent = _received(batches)
        firsts, laters = (sent.get(t, np.zeros(0, np.uint64)) for t in (b"F", b"L"))
        parts = list(C.hashed_words(texts, C.word_hashes()))
        lengths = np.array([len(x) for x in parts], np.int64)
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        del parts
        starts = np.cumsum(lengths) - lengths
        removed = np.zeros(len(words), bool)
        if len(words) >= WINDOW and len(firsts) + len(laters):
            both = np.sort(np.concatenate((firsts, laters)))
            n = len(words) - WINDOW + 1
            valid = np.arange(WINDOW, n + WINDOW) <= np.repeat(starts + lengths, lengths)[:n]
            hashes = C.mixed(C.Rolling(words).raw(WINDOW))
            at = np.flatnonzero(valid)
            at = at[C.isin_sorted(hashes[at], both)]
            numbers = np.unique(words, return_inverse=True)[1].astype(np.int32)
            refers = _located(numbers, starts, lengths, (at, hashes[at]))
            found = np.flatnonzero(refers >= 0)
            ref = refers[found]
            mine = C.isin_sorted(hashes[ref], firsts)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            same_place = (ids[doc[found]] == ids[doc[ref]]) & (found - starts[doc[found]] == ref - starts[doc[ref]])
            gone = found[~(mine & same_place)]
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + WINDOW, -1)
            removed = np.cumsum(edge)[:-1] > 0
        out = []
        for i, (s, size) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            flags, n_removed, spans = removed[s : s + size], 0, []
            own = texts[i].split() if texts[i] else []
            if n_removed := int(flags.sum()):
                kept = b" ".join(w for w, gone in zip(own, flags.tolist(), strict=True) if not gone)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
                spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            else:
                kept = b" ".join(own)
            out.append((None if ids[i] == C.NO_ID else int(ids[i]), size, n_removed, hashlib.sha256(kept).hexdigest(), _signed(xxhash.xxh64_intdigest(texts[i] or b"", 42)), kept.decode("utf-8", "replace") if with_text else None, spans if with_text else None))
            if len(out) >= 2000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def _rows(out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
    names = ("doc_id", "n_words", "n_removed", "kept_sha256", "text_hash", "kept_text", "spans")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, text_hash (Spark's xxhash64 of the text, "" for null) and, with_text, the kept text and the removed spans of words."""
    n = C.buckets(docs)
    texts = C.texts_of(docs)
    cuts = texts.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 2 * n)).alias("c")).first()["c"] if n > 1 else []
    bounds = np.array(sorted(cuts or []), np.int64)
    sent = C.mapped(texts, _send_anchors(bounds, n), C.PACKED).repartitionById(n, F.col("k"))
    anchors = sent.mapInArrow(_recurring_anchors, C.PACKED).mapInArrow(_tagged(b"A"), C.PACKED)
    packed = C.mapped(texts, _send_texts(bounds), C.PACKED)
    windows = C.mapped(packed.unionAll(anchors).repartitionById(n, F.col("k")), _send_windows(n), C.PACKED)
    marks = windows.repartitionById(n, F.col("k")).mapInArrow(_confirmed_windows, C.PACKED)
    return C.mapped(packed.unionAll(marks).repartitionById(n, F.col("k")), _cleaned(with_text), SCHEMA)
