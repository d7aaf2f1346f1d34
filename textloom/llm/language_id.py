"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes from both sides, its state going on from word
to word; every byte position gets a distribution over the languages, and a
document's distribution is the mean over all positions of its whole text.
Texts are read in windows of ``STRIDE`` bytes, with ``MARGIN`` bytes of context
on both sides that are read but not counted, so each position is labelled once
and a text of any length takes bounded memory.

The network is trained in numpy by backpropagation through time, with Adam.  It
learns from at most ``SAMPLE`` documents (least hashes of doc_id) whose language
is given and whose doc_id is not held out; of each, an extract of ``EXTRACT``
characters from a place that a hash chooses; and of the extracts, ``PIECES``
pieces of ``PIECE`` bytes, as many of each language.  Only training is sampled.
Neither language, source nor doc_id enters a prediction.

Null text, or text without a letter (Unicode category L): ``und`` with score 1.
If nothing can be learned, ``und`` with score 0.  A null doc_id is never learned
from and not held out.  Repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

SAMPLE, FOLDS, HELD = 3000, 4, 2
EXTRACT, PIECES, PIECE = 400, 4000, 96
HIDDEN, BATCH, EPOCHS, RATE = 12, 128, 6, 0.02
STRIDE, MARGIN, AT_ONCE = 448, 32, 1024
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class BiGru:
    """Weights by name; ``f`` reads forwards, ``b`` backwards; gates in the order update, reset, new."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 1):
        r = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.w = {"out": r.normal(0, 0.3, (2 * hidden, len(langs))), "bias": np.zeros(len(langs))}
        for d in "fb":
            self.w[d + "x"] = r.normal(0, 0.3, (256, 3 * hidden))
            self.w[d + "h"] = r.normal(0, 0.3, (hidden, 3 * hidden))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _read(self, d, x, live, keep):
        """Hidden states of all steps, (steps, rows, hidden); rows come longest first, ``live`` of them in each step."""
        n, wx, wh = self.hidden, self.w[d + "x"], self.w[d + "h"]
        h = np.zeros((x.shape[1], n), wx.dtype)
        states, saved = np.zeros((len(x), *h.shape), wx.dtype), []
        for t, m in enumerate(live):
            a, u = wx[x[t, :m]], h[:m] @ wh
            zr = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * n] + u[:, : 2 * n]))
            z, r, u = zr[:, :n], zr[:, n:], u[:, 2 * n :]
            c = np.tanh(a[:, 2 * n :] + r * u)
            if keep:
                saved.append((h[:m], z, r, c, u))
            h = h[:m] + z * (c - h[:m])
            states[t, :m] = h
        return states, saved

    def _back(self, d, x, live, saved, dh_all, grads):
        n, wh = self.hidden, self.w[d + "h"]
        dh = np.zeros((0, n), wh.dtype)
        for t in range(len(live) - 1, -1, -1):
            h, z, r, c, u = saved[t]
            g = dh_all[t, : live[t]].copy()
            g[: len(dh)] += dh
            dc = g * z * (1 - c * c)
            dz, dr = g * (c - h) * z * (1 - z), dc * u * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], 1)
            grads[d + "h"] += h.T @ du
            np.add.at(grads[d + "x"], x[t, : live[t]], np.concatenate([dz, dr, dc], 1))
            dh = g * (1 - z) + du @ wh.T

    def gradients(self, pieces: list[bytes], labels: np.ndarray):
        """Loss and gradients of the mean cross-entropy over all positions of the pieces."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        lengths, labels = np.array([len(pieces[i]) for i in order]), labels[order]
        steps = np.arange(int(lengths[0]))
        live = (lengths > steps[:, None]).sum(1).tolist()
        forward, backward = (np.frombuffer(b"".join(pieces[i][::way].ljust(len(steps), b"\0") for i in order), np.uint8).reshape(len(order), -1).T for way in (1, -1))
        mask = (steps[:, None] < lengths)[:, :, None]
        turn = np.where(mask[:, :, 0], lengths - 1 - steps[:, None], 0)[:, :, None]
        f, kept_f = self._read("f", forward, live, True)
        b, kept_b = self._read("b", backward, live, True)
        h = np.concatenate([f, np.take_along_axis(b, turn, 0)], 2) * mask
        p = h @ self.w["out"] + self.w["bias"]
        p = np.exp(p - p.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        rows, count = np.arange(len(order)), lengths.sum()
        loss = -(np.log(np.maximum(p[:, rows, labels], 1e-9)) * mask[:, :, 0]).sum() / count
        p[:, rows, labels] -= 1
        p *= mask / count
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["out"], grads["bias"] = np.einsum("trh,trl->hl", h, p), p.sum((0, 1))
        dh, n = p @ self.w["out"].T, self.hidden
        self._back("f", forward, live, kept_f, dh[:, :, :n], grads)
        self._back("b", backward, live, kept_b, np.take_along_axis(dh[:, :, n:], turn, 0) * mask, grads)
        return loss, grads

    def train(self, pieces: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 2) -> BiGru:
        r, step = np.random.default_rng(seed), 0
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for epoch in range(epochs):
            order = r.permutation(len(pieces))
            for at in range(0, len(order), BATCH):
                i = order[at : at + BATCH]
                _, grads = self.gradients([pieces[j] for j in i], labels[i])
                step += 1
                now = rate * 0.6**epoch
                for k, g in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.w[k] -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def reader(self) -> _Reader:
        return _Reader(self)


class _Reader:
    """Inference: all windows in step, one contiguous array for each gate, results in the order of steps."""

    def __init__(self, model: BiGru):
        n = model.hidden
        self.n, self.model = n, model
        gates = [slice(0, n), slice(n, 2 * n), slice(2 * n, 3 * n)]
        # sigmoid(x) = 1 / (1 + exp(-x)) and tanh(x) = 2 / (1 + exp(-2x)) - 1: the signs and the 2 lie in the weights
        self.x, self.h = ({d: [np.ascontiguousarray(model.w[d + kind][:, g] * s) for g, s in zip(gates, (-1, -1, -2), strict=True)] for d in "fb"} for kind in "xh")

    def _read(self, d, data, first, way, live, logits):
        n, xs, hs = self.n, self.x[d], self.h[d]
        out = np.ascontiguousarray(self.model.w["out"][:n] if d == "f" else self.model.w["out"][n:])
        h, a, z, r, c = (np.zeros((live[0], n), np.float32) for _ in range(5))
        one, two, most = np.float32(1), np.float32(2), np.float32(80)
        done = 0
        for t, m in enumerate(live):
            byte, hm, am, zm, rm, cm = data[first[:m] + way * t], h[:m], a[:m], z[:m], r[:m], c[:m]
            for gate, x, w in ((zm, xs[0], hs[0]), (rm, xs[1], hs[1])):
                np.matmul(hm, w, out=gate)
                np.take(x, byte, axis=0, out=am, mode="clip")
                gate += am
                np.minimum(gate, most, out=gate)
                np.exp(gate, out=gate)
                gate += one
            np.matmul(hm, hs[2], out=cm)
            cm /= rm
            np.take(xs[2], byte, axis=0, out=am, mode="clip")
            cm += am
            np.minimum(cm, most, out=cm)
            np.exp(cm, out=cm)
            cm += one
            np.divide(two, cm, out=cm)
            cm -= one
            cm -= hm
            cm /= zm
            hm += cm
            np.matmul(hm, out, out=logits[done : done + m])
            done += m

    def sums(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, core_begin: np.ndarray, core_end: np.ndarray) -> np.ndarray:
        """Summed probabilities over the core of each window [begin, end) of the bytes; no window is empty."""
        order = np.argsort(begin - end, kind="stable")
        begin, size, skip, core = begin[order], (end - begin)[order], (core_begin - begin)[order], (core_end - core_begin)[order]
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        offset = np.cumsum(live) - live
        step, total = np.repeat(np.arange(len(live)), live), int(live.sum())
        row = np.arange(total) - offset[step]
        f, b = (np.empty((total, len(self.model.langs)), np.float32) for _ in range(2))
        self._read("f", data, begin, 1, live.tolist(), f)
        self._read("b", data, begin + size - 1, -1, live.tolist(), b)
        f += np.take(b, offset[size[row] - 1 - step] + row, axis=0)  # the same position, read from behind
        f += self.model.w["bias"]
        p = [np.ascontiguousarray(c) for c in f.T]
        top = p[0].copy()
        for c in p[1:]:
            np.maximum(top, c, out=top)
        for c in p:
            c -= top
            np.exp(c, out=c)
        weight = ((step >= skip[row]) & (step < (skip + core)[row])) / sum(p)
        out = np.empty((len(order), len(p)))
        for k, c in enumerate(p):
            out[order, k] = np.bincount(row, c * weight, len(order))
        return out

    def documents(self, texts: list[bytes | None]) -> np.ndarray:
        """Mean distribution over all positions of each text; zeros for one without bytes."""
        sizes = np.array([len(t or b"") for t in texts], np.int64)
        data = np.frombuffer(b"".join(t for t in texts if t).translate(_LOWER), np.uint8)
        starts = np.cumsum(sizes) - sizes
        n = -(-sizes // STRIDE)
        doc = np.repeat(np.arange(len(texts)), n)
        core = starts[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        stop = starts[doc] + sizes[doc]
        out = np.zeros((len(texts), len(self.model.langs)))
        for cut in range(0, len(doc), AT_ONCE):
            own, at, last = doc[cut : cut + AT_ONCE], core[cut : cut + AT_ONCE], stop[cut : cut + AT_ONCE]
            core_end = np.minimum(at + STRIDE, last)
            np.add.at(out, own, self.sums(data, np.maximum(at - MARGIN, starts[own]), np.minimum(core_end + MARGIN, last), at, core_end))
        return out / np.maximum(sizes, 1)[:, None]


def fitted(texts: list[bytes], langs: list[str], pieces: int = PIECES) -> BiGru | None:
    """Trained on as many pieces of each language, from places that chance chooses in its texts."""
    names = sorted({lang for t, lang in zip(texts, langs, strict=True) if t})
    if not names:
        return None
    r, own, labels = np.random.default_rng(3), [], []
    for k, name in enumerate(names):
        pool = [t.translate(_LOWER) for t, lang in zip(texts, langs, strict=True) if lang == name and t]
        for i in r.integers(0, len(pool), max(1, pieces // len(names))).tolist():
            at = int(r.integers(0, max(1, len(pool[i]) - PIECE + 1)))
            own.append(pool[i][at : at + int(r.integers(PIECE // 4, PIECE + 1))])
            labels.append(k)
    return BiGru(names).train(own, np.array(labels))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD


def train(docs: DataFrame, sample: int = SAMPLE) -> BiGru | None:
    """Fitted on at most ``sample`` extracts; a threshold on the hash keeps what each task sends small."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.xxhash64("doc_id").alias("mix"))
    part = min(1.0, 2 * sample / max(1, known.count()))
    near = known.where(F.pmod("mix", F.lit(1 << 30)) <= int(part * (1 << 30))).where("text IS NOT NULL")
    place = F.pmod(F.shiftright("mix", 7), F.greatest(F.lit(1), F.length("text") - EXTRACT)) + 1
    chosen = near.select("mix", "doc_id", F.substring("text", place.cast("int"), F.lit(EXTRACT)).alias("extract"), "lang").orderBy("mix", "doc_id", "extract", "lang").limit(sample)
    rows = chosen.collect()  # at most ``sample`` rows of EXTRACT characters
    return fitted([r["extract"].encode("utf-8", "replace") for r in rows], [r["lang"] for r in rows])


def predictions(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs."""

    def run(batches):
        reader = model.reader() if model else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if model:
                lettered = np.array([bool(t) and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], bool)
                score[~lettered] = 1.0
                at = np.flatnonzero(lettered)
                mean = reader.documents([texts[i] for i in at.tolist()])
                best = mean.argmax(1)
                score[at] = np.minimum(1.0, mean[np.arange(len(at)), best])
                for i, k in zip(at.tolist(), best.tolist(), strict=True):
                    pred[i] = model.langs[k]
            held = pa.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD for i in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), held, pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return C.mapped(C.texts_of(docs), run, SCHEMA)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return predictions(docs, train(docs, sample))
