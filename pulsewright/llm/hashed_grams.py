"""Averaged hashed subword embeddings with a linear head: features, training in numpy, scoring by gathering.

A text's features are its runs of 2, 3 and 4 bytes (after a byte-to-byte fold),
hashed into buckets. The text's vector is the mean of their buckets' embeddings
and a linear softmax follows. As both are linear, a trained model scores with one
table: each bucket's contribution to each class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pulsewright.llm import textkit as K

GRAMS = (2, 3, 4)
BITS = 16
DIM = 16
#: Features of each size of run that a training text gives, drawn from all of it: what the driver holds of a text.
POOL = 512
_ODD = np.uint32(2654435761)

#: For languages: letters lower-cased, all else below 0x80 is one blank.
LETTERS = np.where(np.arange(256) >= 0x80, np.arange(256), 0x20).astype(np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
#: For quality: bytes as they are, digits alike.
SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[48:58] = 48


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from each place on; len(data) - n + 1 of them."""
    x = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for i in range(n):
        x |= data[i : len(data) - n + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    return _bucket(x, n)


def pools(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Buckets of POOL runs of each size, drawn from all of each text: texts x sizes x POOL; zeros for texts shorter than the largest run."""
    out = np.zeros((len(offsets) - 1, len(GRAMS), POOL), np.uint16)
    for r, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if hi - lo >= max(GRAMS):
            rng = np.random.default_rng(int(seeds[r]))
            for g, n in enumerate(GRAMS):
                at = lo + (rng.random(POOL) * (hi - lo - n + 1)).astype(np.int64)
                x = np.zeros(POOL, np.uint32)
                for i in range(n):
                    x |= fold[data[at + i]].astype(np.uint32) << np.uint32(8 * i)
                out[r, g] = _bucket(x, n)
    return out


def drawn(fold: np.ndarray, key: str, carry: list[str]):
    """A function for mapInArrow: rows (key, text, ...) to carry, n (bytes) and pool (binary), each text's pool drawn by its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in K.chunks(b.column("text")):
                pool = pools(data, offsets, b.column(key).slice(i, j - i).to_numpy().view(np.uint64), fold)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in carry), pa.array(np.diff(offsets)), pa.array([p.tobytes() for p in pool], pa.binary())], [*carry, "n", "pool"])

    return run


def pool_of(rows: list) -> np.ndarray:
    """The pools of collected rows."""
    return np.frombuffer(b"".join(r["pool"] for r in rows), np.uint16).reshape(len(rows), len(GRAMS), POOL)


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    x = (x ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * _ODD
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    return (x >> np.uint32(32 - BITS)).astype(np.int32)


def means(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over each text's features; zeros for a text without any."""
    total = np.zeros((len(offsets) - 1, table.shape[1]))
    count = np.zeros(len(offsets) - 1)
    for n in GRAMS:
        h = buckets(data, n)
        if not len(h):
            continue
        lo, hi = offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])
        hi, lo = np.minimum(hi, len(h)), np.minimum(lo, len(h))
        for c in range(table.shape[1]):
            run = np.zeros(len(h) + 1)
            np.cumsum(table[h, c], out=run[1:])
            total[:, c] += run[hi] - run[lo]
        count += hi - lo
    return total / np.maximum(count, 1)[:, None]


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x classes, float32
    bias: np.ndarray
    scale: float = 1.0  # calibrates the logits
    least: np.ndarray | None = None  # evidence below it is rejected, by length class

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return means(data, offsets, self.table) + self.bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, offsets) * self.scale)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(pool: np.ndarray, targets: np.ndarray, labels: list[str], epochs: int = 12, per_text: int = 255, batch: int = 32, rate: float = 0.5, seed: int = 1) -> Model:
    """Stochastic gradient descent on soft targets (texts x classes); each step sees `per_text` features of each of `batch` texts, drawn anew from their pools."""
    rng = np.random.default_rng(seed)
    n, each = len(pool), per_text // len(GRAMS)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    head = rng.normal(0, 0.1, (DIM, targets.shape[1])).astype(np.float32)
    bias = np.zeros(targets.shape[1], np.float32)
    steps, done = epochs * -(-n // batch), 0
    for _ in range(epochs):
        for s in np.array_split(rng.permutation(n), -(-n // batch) or 1):
            if not len(s):
                continue
            lr = rate * (1 - done / steps)
            done += 1
            at = pool[s][:, :, rng.integers(0, POOL, each)].reshape(len(s), -1)
            x = emb[at].mean(1)
            g = (softmax(x @ head + bias) - targets[s]).astype(np.float32)
            dx = g @ head.T
            head -= lr * x.T @ g / len(s)
            bias -= lr * g.mean(0)
            np.subtract.at(emb, at.reshape(-1), np.repeat(lr * 20 * dx / at.shape[1], at.shape[1], 0))
    return Model(labels, (emb @ head).astype(np.float32), bias.astype(float))


def calibrate(model: Model, logits: np.ndarray, targets: np.ndarray) -> Model:
    """Choose the scale of the logits that makes the labels of these texts likeliest."""
    if len(logits):
        loss = {c: -np.mean(np.sum(targets * np.log(softmax(logits * c) + 1e-12), 1)) for c in np.geomspace(0.1, 30, 40)}
        model.scale = min(loss, key=loss.get)
    return model
