"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per text, with a softmax on top.

Training is stochastic gradient descent in numpy on a bounded sample. For scoring, the linear output layer is folded
into the embedding, so that every hash bucket has one number per class and a text's logits are plain averages; they
come from whole Arrow batches with numpy, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

BITS, DIM, EPOCHS, RATE = 16, 12, 6, 0.5
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
_PAD = b"\n" * 4
_R = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_R, 1)
_INVERSE = _powers(pow(_R, -1, 1 << 64), 1)


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    return (((x + np.uint64(salt)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[bytes], grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature occurrence, first feature of each text): all n-grams of bytes, then all words, of the
    texts in order. Each text stands between paddings, so its features don't depend on its neighbours, and there is
    at least one for every text."""
    global _POWER, _INVERSE
    data = np.frombuffer(_PAD + _PAD.join(texts) + _PAD, np.uint8)
    n = len(data)
    if n > len(_POWER):
        _POWER, _INVERSE = _powers(_R, n), _powers(pow(_R, -1, 1 << 64), n)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(sizes + len(_PAD)) - sizes  # of each text's bytes in data
    wide = data.astype(np.uint64)
    code, columns, firsts = wide.copy(), [], []
    for k in range(1, max(grams)):
        code[:-k] |= wide[k:] << np.uint64(8 * k)
        if k + 1 in grams:
            columns.append(_bucket(code, k))
            firsts.append(start - 1)  # from the blank before the text to its last byte
    space = data <= 32
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * _POWER[:n])])
    words = (run[end] - run[begin]) * _INVERSE[begin]
    first_word = np.searchsorted(begin, np.append(start, n))
    out, at = [], [0]
    word_buckets = _bucket(words, 77)
    for i, s in enumerate(sizes.tolist()):
        for c, f in zip(columns, firsts, strict=True):
            out.append(c[f[i] : f[i] + s + 1])
        out.append(word_buckets[first_word[i] : first_word[i + 1]])
        at.append(at[-1] + len(columns) * (s + 1) + len(out[-1]))
    return np.concatenate(out), np.array(at[:-1], np.int64)


def bag(text: bytes, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    found, count = np.unique(features([text], grams)[0], return_counts=True)
    return found.astype(np.int32), (count / count.sum()).astype(np.float32)


@dataclass
class Model:
    """table: bucket by class; a text's logits are scale * (average of its buckets' rows + bias); seen: training texts of
    each class."""

    classes: list
    table: np.ndarray
    bias: np.ndarray
    grams: tuple[int, ...]
    scale: float = 1.0
    seen: dict = field(default_factory=dict)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = self.scale * logits
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty((len(texts), len(self.classes)))
        a, size = 0, 0
        for b, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or b + 1 == len(texts):
                found, first = features(texts[a : b + 1], self.grams)
                counts = np.diff(np.append(first, len(found)))
                for c in range(len(self.classes)):
                    sums = np.add.reduceat(self.table[c].take(found), first, dtype=np.float64)
                    out[a : b + 1, c] = sums / counts + self.bias[c]
                a, size = b + 1, 0
        return out


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list, grams: tuple[int, ...], seed: int = 0) -> Model:
    """Model of the labels, with the output layer folded into the embedding."""
    classes = sorted(set(labels))
    embedding, output, bias = descend(bags, labels, classes, seed)
    return Model(classes, np.ascontiguousarray((embedding @ output).T), bias.astype(np.float64), grams)


def descend(bags: list[tuple[np.ndarray, np.ndarray]], labels: list, classes: list, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embedding, output, bias) by stochastic gradient descent on the softmax loss, one text at a time, with a falling rate."""
    at = {c: i for i, c in enumerate(classes)}
    y = np.array([at[x] for x in labels])
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    steps, step = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)).tolist():
            found, share = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ embedding[found]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= rate * p
            # Shares are small numbers: the embedding's rate makes up for the averaging.
            embedding[found] -= (20 * rate) * share[:, None] * back[None]
    return embedding, output, bias


def calibrate(model: Model, bags: list[tuple[np.ndarray, np.ndarray]], labels: list) -> Model:
    """model with the scale (of a fixed list) that gives held-back texts the best likelihood."""
    if not bags:
        return model
    at = {c: i for i, c in enumerate(model.classes)}
    known = [i for i, x in enumerate(labels) if x in at]
    z = np.array([[float(share @ t[found]) for t in model.table] for found, share in bags]) + model.bias
    y = np.array([at[labels[i]] for i in known])

    def loss(scale: float) -> float:
        model.scale = scale
        return -np.log(np.maximum(model.probabilities(z[known])[np.arange(len(y)), y], 1e-12)).mean() if known else 0.0

    model.scale = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return model


def text_bytes(column: pa.Array, fold: bool) -> list[bytes]:
    """UTF-8 of each text, empty for null; fold: in lower case."""
    texts = ((x or "") for x in column.to_pylist())
    return [(t.lower() if fold else t).encode("utf-8", "surrogatepass") for t in texts]


def bags_of(batches: Iterator[pa.RecordBatch], grams: tuple[int, ...], fold: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (label, text) to (label, found, share)."""
    for b in batches:
        rows = [bag(t, grams) for t in text_bytes(b.column(1), fold)]
        found = pa.array([r[0] for r in rows], pa.list_(pa.int32()))
        share = pa.array([r[1] for r in rows], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column(0), found, share], ["label", "found", "share"])
