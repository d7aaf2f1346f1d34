"""Repetition coverage: characters inside duplicated n-grams and lines.

For each n-gram length, rolling 64-bit hashes of a text's words are sorted in
numpy; a window whose hash stood earlier in the text is a duplicate, and the
code points of the words that duplicates cover are counted once.  Duplicate
lines count the code points of their words.  A text fails when the share of its
word characters inside duplicates is over the limit of any length in NGRAMS,
or over LINES inside duplicate lines.  The base counts and verdict stand
beside.

Null or empty text: zero counts, base_failed (fewer than 10 words).  Every row
gets a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import common as C

#: n-gram length: largest share of word characters inside duplicates.
NGRAMS = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}
LINES = 0.30
MIN_WORDS, REPEAT_GRAM, REPEAT_PERCENT = 10, 5, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NAMES = (*COUNTS, "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAMS))
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in NAMES) + ", base_failed boolean, kept boolean"

_SPACE, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL[list(b"#*$%&|<>")] = True


def _covered(flags: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the flagged windows of n words."""
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _occurrences(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window: it is found twice or more; it stood earlier."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    often, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    later[order[1:][same]] = True
    return often, later


def measured(text: bytes | None, cache: C.WordHashes) -> tuple[int, ...]:
    """NAMES of one text."""
    words = text.split() if text else []
    if not words:
        return (0, 0, int(_SYMBOL[np.frombuffer(text or b"", np.uint8)].sum()), 0, 0, 0, *(0 for _ in NGRAMS))
    data = np.frombuffer(text, np.uint8)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    chars = points[edges[1::2]] - points[edges[::2]]
    seen, dup_lines, dup_line_chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():  # strips the same bytes that part words
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            seen.add(line)
    roll = C.Rolling(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    repeated, inside_dups = 0, []
    for n in NGRAMS:
        if len(words) < n:
            inside_dups.append(0)
            continue
        often, later = _occurrences(roll.raw(n))
        if n == REPEAT_GRAM and often.any():
            repeated = int(_covered(often, n, len(words)).sum())
        inside_dups.append(int(chars[_covered(later, n, len(words))].sum()) if later.any() else 0)
    return (len(words), int(chars.sum()), int(_SYMBOL[data].sum()), dup_lines, repeated, dup_line_chars, *inside_dups)


def _verdicts(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept of rows of NAMES."""
    col = dict(zip(NAMES, table.T, strict=True))
    failed = (col["n_words"] < MIN_WORDS) | (100 * col["n_repeat_words"] > REPEAT_PERCENT * col["n_words"])
    bad = col["dup_line_chars"] > LINES * col["word_chars"]
    for n, limit in NGRAMS.items():
        bad |= col[f"dup_{n}gram_chars"] > limit * col["word_chars"]
    return failed, ~failed & ~bad


def _table(texts: list, cache: C.WordHashes) -> np.ndarray:
    return np.array([measured(t, cache) for t in texts], np.int64).reshape(-1, len(NAMES))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""

    def judge():
        cache = C.word_hashes()
        return lambda texts: _verdicts(_table(texts, cache))[1]

    return C.filtered(docs, judge)


def repetition_quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row of docs."""

    def run(batches):
        cache = C.word_hashes()
        for batch in batches:
            ids, texts = C.columns(batch, "doc_id", "text")
            table = _table(texts.to_pylist(), cache)
            failed, kept = _verdicts(table)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, table.T), pa.array(failed), pa.array(kept)], names=["doc_id", *NAMES, "base_failed", "kept"])

    return C.mapped(C.texts_of(docs), run, SCHEMA)
