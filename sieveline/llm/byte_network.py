"""A convolutional network over bytes, in numpy.

A text's UTF-8 bytes are covered by overlapping chunks. In each chunk, every filter sees eight bytes at every second
place; a filter is one learned number for each byte value at each of its places. Its greatest response in the chunk
is kept. The greatest, mean and least of these over all chunks of the text, for every filter, make one logistic score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .text_words import row_groups, text_bytes

CHUNK, STEP, WIDTH, STRIDE = 512, 384, 8, 2
PLACES = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks that are looked at together.
TOGETHER = 16


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, start): text ``i`` has the chunks ``first[i]`` to ``first[i + 1]``, which start at ``start``."""
    size = np.diff(offsets)
    count = 1 + np.maximum(-(-(size - CHUNK) // STEP), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    number = np.arange(first[-1]) - np.repeat(first[:-1], count)
    return first, np.repeat(offsets[:-1], count) + number * STEP


def chunk_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of chunks as rows; places past the end of the text are 0."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0)


@dataclass
class ByteNetwork:
    filters: np.ndarray  # place in the filter, byte, filter
    bias: np.ndarray
    weight: np.ndarray  # greatest, mean, least of each filter
    offset: float

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Response of every filter at every place of each chunk."""
        out = np.broadcast_to(self.bias, (len(rows), PLACES, len(self.bias))).copy()
        one = np.empty_like(out)
        for j in range(WIDTH):
            np.take(self.filters[j], rows[:, j:j + STRIDE * PLACES - 1:STRIDE], axis=0, out=one, mode="clip")
            out += one
        return out

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, greatest): the greatest responses in each chunk, not below 0."""
        first, start = chunks(data, offsets)
        end = np.repeat(offsets[1:], np.diff(first))
        out = np.empty((len(start), len(self.bias)), np.float32)
        for at in range(0, len(start), TOGETHER):
            some = slice(at, at + TOGETHER)
            out[some] = self.responses(chunk_bytes(data, start[some], end[some])).max(axis=1)
        return first, np.maximum(out, 0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A probability for each text; null counts as empty, which is one chunk of zeros."""
        out = [np.zeros(0)]
        for low, high in row_groups(texts, 1 << 20):
            first, top = self.pooled(*text_bytes(texts.slice(low, high - low)))
            logit = features(first, top) @ self.weight + self.offset
            out.append(1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))))
        return np.concatenate(out)


def features(first: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Greatest, mean and least over the chunks of each text."""
    return np.hstack([np.maximum.reduceat(top, first[:-1]), np.add.reduceat(top, first[:-1]) / np.diff(first)[:, None],
                      np.minimum.reduceat(top, first[:-1])])


def fit(texts: pa.Array, label: np.ndarray, filters: int = 16, rounds: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 3) -> ByteNetwork:
    """Fit by Adam on the logistic loss; gradients pass through the places of greatest response."""
    rng = np.random.default_rng(seed)
    net = ByteNetwork(rng.normal(0, 0.1, (WIDTH, 256, filters)).astype(np.float32), np.zeros(filters, np.float32),
                      rng.normal(0, 0.1, 3 * filters).astype(np.float32), 0.0)
    if not len(label):
        return net
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    values = [net.filters, net.bias, net.weight, np.array([np.log(share / (1 - share))], np.float32)]
    net.offset = float(values[3][0])
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    data, offsets = text_bytes(texts)
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            step += 1
            some = order[at:at + batch]
            gradients = _gradients(net, data, offsets, some, label[some])
            for v, g, (m, s) in zip(values, gradients, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
            net.offset = float(values[3][0])
    return net


def _gradients(net: ByteNetwork, data, offsets, some, label):
    size = offsets[some + 1] - offsets[some]
    count = 1 + np.maximum(-(-(size - CHUNK) // STEP), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(offsets[some], count) + (np.arange(first[-1]) - np.repeat(first[:-1], count)) * STEP
    rows = chunk_bytes(data, start, np.repeat(offsets[some + 1], count))
    best, top = [], []
    for low in range(0, len(rows), TOGETHER):
        response = net.responses(rows[low:low + TOGETHER])
        best.append(response.argmax(axis=1))
        top.append(response.max(axis=1))
    best, top = np.concatenate(best), np.maximum(np.concatenate(top), 0)
    seen = features(first, top)
    logit = seen @ net.weight + net.offset
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) / len(some)
    n = len(net.bias)
    pull = error[:, None] * net.weight
    of = np.repeat(np.arange(len(some)), count)
    back = pull[of, n:2 * n] / count[of][:, None]
    back = back + pull[of, :n] * (top == seen[of, :n]) + pull[of, 2 * n:] * (top == seen[of, 2 * n:])
    back = np.where(top > 0, back, 0)
    flat = np.zeros((WIDTH, 256 * n))
    chunk, kind = np.arange(len(rows))[:, None], np.arange(n)
    for j in range(WIDTH):
        cell = rows[chunk, best * STRIDE + j].astype(np.int64) * n + kind
        flat[j] = np.bincount(cell.ravel(), back.ravel(), 256 * n)
    return [flat.reshape(WIDTH, 256, n).astype(np.float32), back.sum(axis=0).astype(np.float32),
            (error @ seen).astype(np.float32), np.array([error.sum()], np.float32)]
