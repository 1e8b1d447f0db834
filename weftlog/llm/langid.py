"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It reads segments of UTF-8
bytes, labels every byte, and a document's probabilities are the mean over all its bytes. The
gates use x / (1 + |x|) in place of tanh, which is several times cheaper and as good here.
Segments start from a zero state, so memory does not grow with a text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.base import map_batches

HIDDEN = 8
SEGMENT = 96
# The classifier is fitted on at most this many documents of a language and segments of a document.
TRAIN_DOCS_PER_LANG = 200
TRAIN_SEGMENTS_PER_DOC = 8
TRAIN_STEPS = 250
TRAIN_BATCH = 64
LEARNING_RATE = 0.02
# Segments the network reads at once: its arrays then stay in the processor's cache.
READ_SEGMENTS = 2048

LETTER = re.compile(r"[^\W\d_]")


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Direction:
    """One gated recurrent layer; `x` (gate inputs by byte) already holds embedding times weights and bias."""

    def __init__(self, rng: np.random.Generator, h: int):
        self.x = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
        self.u = rng.normal(0, 0.5 / np.sqrt(h), (h, 2 * h)).astype(np.float32)
        self.c = rng.normal(0, 0.5 / np.sqrt(h), (h, h)).astype(np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c]


class Network:
    def __init__(self, langs: list[str], h: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, h
        self.ahead, self.back = Direction(rng, h), Direction(rng, h)
        self.out = rng.normal(0, 0.3, (2 * h, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights, *self.back.weights, self.out, self.bias]

    def _run(self, d: Direction, steps: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (time, segment, unit); `steps` is (time, segment), padding has mask 0."""
        h = self.h
        state = np.zeros((steps.shape[1], h), np.float32)
        out = np.empty((len(steps), steps.shape[1], h), np.float32)
        for t, byte in enumerate(steps):
            gates = d.x[byte]
            a = gates[:, :2 * h] + state @ d.u
            z, r = np.hsplit(0.5 + 0.5 * _soft(a), 2)
            inner = r * state
            b = gates[:, 2 * h:] + inner @ d.c
            cand = _soft(b)
            m = mask[t][:, None]
            new = (state + z * (cand - state)) * m
            if keep is not None:
                keep.append((byte, state, a, z, r, b, cand, inner, m))
            state = out[t] = new
        return out

    def _states(self, seg: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        steps, m = np.ascontiguousarray(seg.T), np.ascontiguousarray(mask.T)
        one, two = keep or (None, None)
        left = self._run(self.ahead, steps, m, one)
        right = self._run(self.back, steps[::-1], m[::-1], two)[::-1]
        return np.concatenate([left, right], axis=2)

    def label(self, seg: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities of every position: (time, segment, language)."""
        x = self._states(seg, mask) @ self.out + self.bias
        x -= x.max(axis=2, keepdims=True)
        np.exp(x, out=x)
        return x / x.sum(axis=2, keepdims=True)

    def gradients(self, seg: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, in the order of `weights`."""
        keep: tuple[list, list] = ([], [])
        states = self._states(seg, mask, keep)
        logits = states @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        m = mask.T
        n = m.sum()
        hot = np.eye(len(self.langs), dtype=np.float32)[y]
        loss = float(-(np.log(np.maximum((p * hot).sum(2), 1e-9)) * m).sum() / n)
        d = (p - hot) * m[:, :, None] / n
        flat, dflat = states.reshape(-1, 2 * self.h), d.reshape(-1, d.shape[2])
        d_states = d @ self.out.T
        grads = self._through_time(self.ahead, keep[0], d_states[:, :, :self.h])
        grads += self._through_time(self.back, keep[1], d_states[::-1, :, self.h:])
        return loss, [*grads, flat.T @ dflat, dflat.sum(0)]

    def _through_time(self, d: Direction, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        h = self.h
        gx, gu, gc = (np.zeros_like(w) for w in d.weights)
        back = np.zeros(d_out.shape[1:], np.float32)
        for (byte, state, a, z, r, b, cand, inner, m), g in zip(reversed(kept), d_out[::-1]):
            g = (g + back) * m
            db = g * z / (1 + np.abs(b)) ** 2
            d_inner = db @ d.c.T
            da = np.concatenate([g * (cand - state), d_inner * state], axis=1) * 0.5 / (1 + np.abs(a)) ** 2
            np.add.at(gx, byte, np.concatenate([da, db], axis=1))
            gu += state.T @ da
            gc += inner.T @ db
            back = g * (1 - z) + d_inner * r + da @ d.u.T
        return [gx, gu, gc]


def segments(data: bytes, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text cut into rows of `size`, and the mask of real bytes."""
    rows = max(1, -(-len(data) // size))
    seg, mask = np.zeros(rows * size, np.uint8), np.zeros(rows * size, np.float32)
    seg[:len(data)], mask[:len(data)] = np.frombuffer(data, np.uint8), 1
    return seg.reshape(rows, size), mask.reshape(rows, size)


def fit(samples: list[tuple[str, str]], *, steps: int = TRAIN_STEPS, seed: int = 7) -> Network:
    """A network fitted on (text, lang) pairs, each language drawn equally often."""
    langs = sorted({lang for _, lang in samples})
    net = Network(langs)
    if len(langs) < 2:
        return net
    rng = np.random.default_rng(seed)
    rows: dict[int, list] = {k: [] for k in range(len(langs))}
    for text, lang in samples:
        seg, mask = segments(text.encode())
        pick = rng.permutation(len(seg))[:TRAIN_SEGMENTS_PER_DOC]
        rows[langs.index(lang)] += [(seg[i], mask[i]) for i in pick if mask[i].any()]
    rows = {k: v for k, v in rows.items() if v}
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.choice(list(rows), TRAIN_BATCH)
        drawn = [rows[k][rng.integers(len(rows[k]))] for k in y]
        _, grads = net.gradients(np.stack([s for s, _ in drawn]), np.stack([m for _, m in drawn]), y)
        rate = LEARNING_RATE * (1 - step / (steps + 1))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for w, g, a, b in zip(net.weights, grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
    return net


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text; ("und", 0) without a letter."""
    data = [t.encode() if t and LETTER.search(t) else b"" for t in texts]
    sizes = [-(-len(d) // SEGMENT) for d in data]
    seg = np.zeros((sum(sizes), SEGMENT), np.uint8)
    mask = np.zeros((sum(sizes), SEGMENT), np.float32)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat, flat_mask = seg.reshape(-1), mask.reshape(-1)
    for d, row in zip(data, at):
        lo = row * SEGMENT
        flat[lo:lo + len(d)] = np.frombuffer(d, np.uint8)
        flat_mask[lo:lo + len(d)] = 1
    sums = np.zeros((len(seg) + 1, len(net.langs)))
    for i in range(0, len(seg), READ_SEGMENTS):
        part = slice(i, i + READ_SEGMENTS)
        p = net.label(seg[part], mask[part])
        sums[i + 1:i + 1 + p.shape[1]] = np.einsum("tsl,st->sl", p, mask[part])
    total = np.cumsum(sums, axis=0)
    out = []
    for k, d in enumerate(data):
        if not d or not net.langs:
            out.append(("und", 0.0))
            continue
        mean = (total[at[k + 1]] - total[at[k]]) / len(d)
        best = int(mean.argmax())
        out.append((net.langs[best], float(min(1.0, max(0.0, mean[best])))))
    return out


def held_out(doc_id: Column | str) -> Column:
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = TRAIN_DOCS_PER_LANG) -> list[tuple[str, str]]:
    """At most `per_lang` labelled documents of each language, by the hash of their ids.

    The ranking is cut in every task before it moves. Texts are cut to what can be used.
    """
    longest = SEGMENT * TRAIN_SEGMENTS_PER_DOC * 4
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    top = usable.select("doc_id", "lang").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_lang)
    chosen = usable.select("doc_id", "lang", F.left("text", F.lit(longest)).alias("text")).join(top.select("doc_id", "lang"), ["doc_id", "lang"])
    rows = chosen.distinct().collect()
    return [(r["text"], str(r["lang"])) for r in sorted(rows, key=lambda r: (str(r["lang"]), r["doc_id"], r["text"])) if LETTER.search(r["text"])]


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of `docs` (doc_id, text, lang).

    Null text and texts without a letter give `und` with score 0, as does a table without any
    label. Repeated rows are labelled alike. Nothing moves; the fitted weights are a few kB.
    """
    model = net or fit(training_sample(docs))
    slim = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")

    def run(ids, held, texts):
        found = predict(model, texts)
        return {"doc_id": ids, "held_out": held, "lang_pred": [a for a, _ in found], "score": [b for _, b in found]}

    return map_batches(slim, run, "doc_id bigint, held_out boolean, lang_pred string, score double")
