"""URL filter by a bit-parallel wildcard automaton.

Glob rules over a canonical URL (host and path) are packed, one bit a state,
into 64-bit words.  One Shift-And step moves the states of all patterns at
once: ``D = ((D << 1) & B[c]) | (D & K[c])``, with the carry passed from word to
word; ``*`` is a state that keeps itself on any byte, ``?`` takes the first byte
of a character and keeps itself on its other bytes.  Some URLs are simulated
together, a byte position at a time, as many as ``CELLS`` words of state allow,
so a list of many thousand globs needs no more memory.

The longest fitting rule of a host and path list decides first; other URLs are
blocked when a glob matches the whole canonical URL, A-Z lower-cased.

Null URL or none with ``://``: empty host and path, allowed.  Of rules of one
length that fit, the first listed decides.  Every row, repeated ones too, gets a
row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): the rule fits its host and subdomains where the path starts with its path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
GLOBS = (
    *("*spam*", "*cheap-pills*", "*casino*", "*porn*", "*viagra*", "*free-money*", "*.xxx/*", "*/wp-login.php", "*/ads/*", "*click?track*"),
    *("*/phpmyadmin/*", "*/wp-admin/*", "*/xmlrpc.php", "*/cgi-bin/*", "*/cart/checkout*", "*poker-bonus*", "*payday-loan*", "*replica-watch*", "*/search/label/*", "*/calendar/????-??-??/*"),
)
#: Words of state that are simulated at once.
CELLS = 1 << 18
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


class ShiftAnd:
    """All globs as one automaton over bytes."""

    def __init__(self, globs):
        masks, bits = [], 0
        self.first, self.loops, self.last, self.wild = [], [], [], []
        for glob in globs:
            at, items = bits, []
            loops = [False]
            for c in glob.encode():
                if c == ord("*"):
                    loops[-1] = True
                else:
                    items.append(c)
                    loops.append(False)
            masks += [(at + 1 + i, c) for i, c in enumerate(items)]
            self.wild += [at + 1 + i for i, c in enumerate(items) if c == ord("?")]
            self.first.append(at)
            self.loops += [at + i for i, x in enumerate(loops) if x]
            self.last.append(at + len(items))
            bits += len(items) + 1
        self.words = max(1, -(-bits // 64))
        self.table = np.zeros((256, self.words), np.uint64)
        for bit, c in masks:
            for byte in (*range(128), *range(192, 256)) if c == ord("?") else (c,):
                self.table[byte, bit // 64] |= np.uint64(1 << (bit % 64))
        self.first, self.loops, self.last, self.wild = (self._row(x) for x in (self.first, self.loops, self.last, self.wild))
        self.kept = np.tile(self.loops, (256, 1))
        self.kept[128:192] |= self.wild

    def _row(self, bits):
        row = np.zeros(self.words, np.uint64)
        for bit in bits:
            row[bit // 64] |= np.uint64(1 << (bit % 64))
        return row

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Which texts some glob matches as a whole."""
        size = max(1, CELLS // self.words)
        return np.concatenate([self._matches(texts[at : at + size]) for at in range(0, len(texts), size)] or [np.zeros(0, bool)])

    def _matches(self, texts):
        """Long texts are stepped through alone once the others have ended."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(texts[i] for i in order.tolist()) or b"\0", np.uint8)
        sizes = sizes[order]
        starts = np.cumsum(sizes) - sizes
        state = np.tile(self.first, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            byte = data[starts[:live] + step]
            state[:live] = (moved & self.table[byte]) | (d & self.kept[byte])
        found = np.zeros(len(texts), bool)
        found[order] = (state & self.last).any(1)
        return found


def parts(url: str | None) -> tuple[str, str]:
    """Host, its A-Z lower-cased, and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


class Rules:
    """Rules by host, so a URL looks up its host's suffixes, however many rules there are."""

    def __init__(self, rules):
        self.by: dict[str, list[tuple[int, str, str, str]]] = {}
        for place, (verdict, rule) in enumerate(rules):
            name, slash, rest = rule.partition("/")
            self.by.setdefault(name, []).append((-len(rule), place, slash + rest, rule, verdict))
        for own in self.by.values():
            own.sort()

    def of(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        best, at = None, 0
        while at >= 0:
            found = next((r for r in self.by.get(host[at:], ()) if path.startswith(r[2])), None)
            best = found if best is None or found is not None and found < best else best
            at = host.find(".", at) + 1 or -1
        return best[3:] if best else (None, None)


def url_verdicts(pages: DataFrame, rules=RULES, globs=GLOBS) -> DataFrame:
    """host, path, the deciding rule and the verdict of each row of pages."""

    def run(batches):
        automaton, known = ShiftAnd(globs), Rules(rules)
        for batch in batches:
            split = [parts(u) for u in batch.column(1).to_pylist()]
            ruled = [known.of(h, p) for h, p in split]
            hit = automaton.matches([(h + p.translate(_LOWER)).encode() for h, p in split])
            verdict = [v or ("block" if x else "allow") for (_, v), x in zip(ruled, hit.tolist(), strict=True)]
            text = [pa.array(c, pa.string()) for c in ([h for h, _ in split], [p for _, p in split], [r for r, _ in ruled], verdict)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *text], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, SCHEMA)
