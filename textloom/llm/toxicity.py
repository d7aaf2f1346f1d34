"""Toxic spans by a linear-chain conditional random field.

Two tags, with weights for a word's features (the word, its first four and its
first six letters) and for tag pairs, are fitted by gradient ascent on the
regularised likelihood; forward and backward recursions give its gradient.
The labels of tokens come from the labelled documents: in a toxic document, a
word is a toxic token when it, or its beginning, stands in many toxic and
hardly any other document of the sample.  Scoring runs forward-backward over
every whole text, all documents of a batch in step, and turns marginals into
the document's score by a logistic fit on the largest and the summed marginal.

Fitting uses at most ``SAMPLE`` labelled rows (least hashes of doc_id) of at most
``BYTES`` of text together, never held-out ones; of their sequences of
``SEQUENCE`` tokens all with a toxic token, and of the others evenly spread ones,
``PLAIN`` for each of those or 500.  Everything else covers all rows.  Neither
labels nor language, source or doc_id enter a score.

Null or empty text: the score of no toxic token.  Without labelled rows of both
kinds every score is 0.  Repeated rows each get a row; a null doc_id has no
label and is not held out; the other columns of docs are ignored, as are labels
with nulls.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import common as C

SAMPLE, BYTES, PLAIN, FOLDS = 4000, 48 << 20, 2, 5
#: Least share of toxic documents among those of a toxic word or beginning, expected number of chance finds, tokens in a training sequence.
PURE, CHANCE, SEQUENCE = 0.7, 0.05, 64
SPANS = "array<struct<start:int,end:int>>"
SCHEMA = f"doc_id long, held_out boolean, score double, predicted int, spans {SPANS}"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: bytes) -> tuple[str, ...]:
    w = word.decode("utf-8", "replace").lower().strip("\"'`.,;:!?()[]{}<>*#%$&|-_")
    return ("w" + w, "p" + w[:4], "q" + w[:6]) if w else ("w",)


def _recursions(s, starts, lengths, trans):
    """Odds of the toxic tag from the left (with the token's own score) and from the right, documents in step."""
    t00, t01, t10, t11 = np.exp(trans).ravel()
    e = np.exp(np.clip(s, -30, 30))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    left, right = np.empty_like(e), np.empty_like(e)
    live = int((lengths > 0).sum())
    left[starts[:live]] = e[starts[:live]]
    ends = starts + lengths - 1
    right[ends[:live]] = 1.0
    counts = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0))), side="left")
    for step, n in enumerate(counts.tolist(), 1):
        at = starts[:n] + step
        o = left[at - 1]
        left[at] = e[at] * (t01 + t11 * o) / (t00 + t10 * o)
        at = ends[:n] - step
        q = right[at + 1] * e[at + 1]
        right[at] = (t10 + t11 * q) / (t00 + t01 * q)
    return left, right


def marginals(s, starts, lengths, trans):
    """Probability of the toxic tag at each token."""
    left, right = _recursions(s, starts, lengths, trans)
    odds = left * right
    return odds / (1 + odds)


class Crf:
    """Weights of features and tag pairs, and the document's logistic fit."""

    def __init__(self, weights: dict[str, float], trans: np.ndarray, logistic: np.ndarray | None):
        self.weights, self.trans, self.logistic = weights, trans, logistic

    def scorer(self) -> dict[bytes, float]:
        model = self

        class Words(dict):
            def __missing__(self, word):
                if len(self) >= 400_000:
                    self.clear()
                found = self[word] = sum(model.weights.get(f, 0.0) for f in features(word)) + model.weights["bias"]
                return found

        return Words()

    def document(self, m, starts, lengths) -> np.ndarray:
        """Scores of documents from their tokens' marginals."""
        top, total = np.zeros(len(lengths)), np.zeros(len(lengths))
        some = lengths > 0
        if some.any():
            top[some] = np.maximum.reduceat(m, starts[some])
            total[some] = np.add.reduceat(m, starts[some])
        return 1 / (1 + np.exp(-_pooled(top, total) @ self.logistic))


def _pooled(top, total):
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones_like(top), np.log(top / (1 - top)), np.log(np.maximum(total, 1e-6))], 1)


def _unlike(docs, labels):
    """The sample without near copies: none whose least shingle hash, of any of eight kinds, was there before."""
    cache, seen, kept = C.WordHashes(), set(), []
    salts = C.mixed(np.arange(1, 9, dtype=np.uint64))
    for text, label, h in zip(docs, labels, C.hashed_words(docs, cache), strict=True):
        if len(h):
            shingles = C.Rolling(h).raw(min(3, len(h)))
            own = [int(C.mixed(shingles ^ salt).min()) for salt in salts]
            if seen.isdisjoint(own):
                kept.append((text, label))
            seen.update(own)
    return kept


def _toxic_tokens(docs, labels):
    """Words and beginnings far more frequent in toxic documents of the sample than chance among so many explains."""
    count, n = ({}, {}), [0, 0]
    for text, label in _unlike(docs, labels):
        n[label] += 1
        for f in {f for w in set(text.split()) for f in features(w) if len(f) > 3}:
            count[label][f] = count[label].get(f, 0) + 1
    share = (n[1] + 1) / (sum(n) + 2)
    tested = sum(c > 1 for c in count[1].values())

    def evidence(f):
        c, other = count[1][f], count[0].get(f, 0)
        part = c / (c + other)
        return c * np.log(part / share) + (other * np.log((1 - part) / (1 - share)) if other else 0.0) if part >= PURE else 0.0

    need = np.log(max(1, tested) / CHANCE)
    return {f for f in count[1] if evidence(f) >= need}


def fitted(docs: list[bytes], labels: list[int], rounds: int = 80, rate: float = 0.3, ridge: float = 1e-4) -> Crf:
    """Fits the field on token sequences of labelled documents, then the document's logistic."""
    if len(set(labels)) < 2:
        return Crf({"bias": 0.0}, np.zeros((2, 2)), None)
    toxic = _toxic_tokens(docs, labels)
    with_tag, without, known = [], [], {}
    for text, label in zip(docs, labels, strict=True):
        words = text.split()
        for at in range(0, len(words), SEQUENCE):
            own = [known.setdefault(w, features(w)) for w in words[at : at + SEQUENCE]]
            tags = [int(bool(label) and not toxic.isdisjoint(f)) for f in own]
            (with_tag if any(tags) else without).append((own, tags))
    step = max(1, len(without) // max(500, PLAIN * len(with_tag)))
    sequences = with_tag + without[::step]
    number: dict[str, int] = {}
    tokens = [f for own, _ in sequences for f in own]
    ids = np.array([[number.setdefault(x, len(number)) for x in (*f, *f[-1:] * (3 - len(f)))] for f in tokens])
    y = np.array([t for _, tags in sequences for t in tags], np.float64)
    lengths = np.array([len(tags) for _, tags in sequences])
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(y), bool)
    inner[starts] = False
    prev, cur = np.flatnonzero(inner) - 1, np.flatnonzero(inner)
    w, bias, trans = np.zeros(len(number)), -2.0, np.zeros((2, 2))
    pairs = np.array([[((1 - y[prev]) * (1 - y[cur])).sum(), ((1 - y[prev]) * y[cur]).sum()], [(y[prev] * (1 - y[cur])).sum(), (y[prev] * y[cur]).sum()]])
    scale = np.maximum(np.bincount(ids.ravel(), minlength=len(w)), 5.0)
    for _ in range(rounds):
        s = w[ids].sum(1) + bias
        left, right = _recursions(s, starts, lengths, trans)
        odds = left * right
        m = odds / (1 + odds)
        t, e = np.exp(trans), np.exp(np.clip(s, -30, 30))
        q = e[cur] * right[cur]
        joint = np.stack([np.full(len(cur), t[0, 0]), t[0, 1] * q, t[1, 0] * left[prev], t[1, 1] * left[prev] * q])
        joint = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        miss = y - m
        w += rate * (np.bincount(ids.ravel(), np.repeat(miss, 3), len(w)) / scale * 5 - ridge * w)
        bias += rate * miss.mean()
        trans += rate * (pairs - joint) / np.maximum(pairs.sum(1, keepdims=True), 50)
    model = Crf({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-6} | {"bias": bias}, trans, np.array([0.0, 1.0, 0.0]))
    words, sizes = model.scorer(), np.array([len(d.split()) for d in docs])
    s = np.fromiter((words[x] for d in docs for x in d.split()), np.float64, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    m = marginals(s, begin, sizes, trans)
    top, total, some = np.zeros(len(docs)), np.zeros(len(docs)), sizes > 0
    top[some], total[some] = np.maximum.reduceat(m, begin[some]), np.add.reduceat(m, begin[some])
    x, labels, theta = _pooled(top, total), np.array(labels, float), np.zeros(3)
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-x @ theta))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        theta += np.linalg.solve(h, x.T @ (labels - p) - 0.1 * theta)
    model.logistic = theta
    return model


def held_out(folds: int, fold: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf:
    """The field fitted on at most ``sample`` labelled rows outside the held-out fold."""
    marked = labels.where(F.col("toxic").isin(0, 1) & ~held_out(FOLDS, 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    found = C.texts_of(docs).join(F.broadcast(chosen), "doc_id").withColumn("size", F.octet_length("text"))
    order = (F.xxhash64("doc_id"), "doc_id", "label", "size")
    sizes = found.select("doc_id", "label", "size").orderBy(*order).limit(sample).select(F.sum(F.coalesce("size", F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    count = sizes.where(F.col("sum") <= BYTES).count()
    rows = found.orderBy(*order).limit(count).orderBy("doc_id", "label", "text").collect() if count else []  # at most ``sample`` rows, BYTES together
    return fitted([bytes(r["text"] or b"") for r in rows], [r["label"] for r in rows])


def _spans(text: bytes, flags: np.ndarray) -> list[dict]:
    """Character ranges of runs of flagged words."""
    places = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def scores(docs: DataFrame, model: Crf, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the spans whose marginals reach the threshold."""

    def run(batches):
        cache = model.scorer()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for cut in range(0, len(texts), 2000):
                own = texts[cut : cut + 2000]
                words = [t.split() if t else [] for t in own]
                lengths = np.array([len(w) for w in words], np.int64)
                starts = np.cumsum(lengths) - lengths
                s = np.fromiter((x for w in words for x in map(cache.__getitem__, w)), np.float64, int(lengths.sum()))
                if model.logistic is None:
                    score, m = np.zeros(len(own)), np.zeros(len(s))
                else:
                    m = marginals(s, starts, lengths, model.trans)
                    score = model.document(m, starts, lengths)
                flags = m >= threshold
                hit = np.zeros(len(own), bool)
                hit[np.repeat(np.arange(len(own)), lengths)[flags]] = True
                spans = [_spans(t, flags[a : a + n]) if x else [] for t, a, n, x in zip(own, starts.tolist(), lengths.tolist(), hit.tolist(), strict=True)]
                ids = batch.column(0).slice(cut, len(own))
                held = pa.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids.to_pylist()])
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "held_out", "score", "predicted", "spans"])

    return C.mapped(C.texts_of(docs), run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return scores(docs, train(docs, labels, sample))
