"""A factorization machine over hashed terms, in numpy.

The score of a text is b + sum of w[t] x[t] + sum over pairs of <v[t], v[u]> x[t] x[u], with one hashed bucket t for
each distinct word. The pair terms are summed in linear time by half of (sum of v x)^2 - sum of (v x)^2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .text_words import LOWER, PLAIN, scan

BITS = 18


def hashed_terms(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, bucket, value): the distinct buckets of each text and a damped count of each."""
    words = scan(texts, PLAIN, LOWER)
    code = (words.row().astype(np.int64) << bits) | (words.key >> np.uint64(64 - bits)).astype(np.int64)
    code, count = np.unique(code, return_counts=True)
    first = np.searchsorted(code, np.arange(len(texts) + 1, dtype=np.int64) << bits)
    return first, code & ((1 << bits) - 1), (1 + np.log(count)).astype(np.float32)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the terms of each text; 0 for a text without terms."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, first: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        scaled = self.factor[bucket] * value[:, None]
        pairs = 0.5 * (_sums(scaled, first) ** 2 - _sums(scaled ** 2, first)).sum(axis=1)
        return self.bias + _sums(self.weight[bucket] * value, first) + pairs

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A probability for each text; that of the bias alone for empty ones."""
        return 1 / (1 + np.exp(-np.clip(self.logits(*hashed_terms(texts)), -30, 30)))


def telling(first: np.ndarray, bucket: np.ndarray, label: np.ndarray, bits: int = BITS, least: float = 4.0, texts: int = 5) -> np.ndarray:
    """Buckets in at least ``texts`` texts whose share of positive texts is ``least`` standard errors from the others'."""
    of = np.repeat(label, np.diff(first))
    positive, every = np.bincount(bucket, of, 1 << bits), np.bincount(bucket, minlength=1 << bits)
    ones, zeros = max(label.sum(), 1), max(len(label) - label.sum(), 1)
    share = np.clip(every / max(len(label), 1), 1e-9, 1 - 1e-9)
    error = np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros))
    return (np.abs(positive / ones - (every - positive) / zeros) > least * error) & (every >= texts)


def telling_pairs(first: np.ndarray, bucket: np.ndarray, label: np.ndarray, bits: int = BITS, least: float = 6.0, texts: int = 20,
                  block: int = 512) -> np.ndarray:
    """Buckets of a pair whose terms tell more, or less, together than the sum of what each tells alone.

    The texts are split by a pair into those with both terms, either and none. The pair tells if the shares of positive texts
    differ by ``least`` standard errors from being additive. All pairs with ``texts`` texts in each of the four are tested,
    a block of counts at a time.
    """
    told = np.zeros(1 << bits, dtype=bool)
    n, often = len(label), np.bincount(bucket, minlength=1 << bits)
    common = np.flatnonzero((often >= 2 * texts) & (often <= n - 2 * texts))
    column = np.full(1 << bits, -1)
    column[common] = np.arange(len(common))
    row, at = np.repeat(np.arange(n), np.diff(first)), column[bucket]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    label = label.astype(np.float32)
    spread = label.mean() * (1 - label.mean()) if n else 0.0
    ones, marked = np.bincount(at, label[row], len(common)), np.flatnonzero(label)

    def texts_with(low: int) -> np.ndarray:
        a, b = np.searchsorted(at, [low, low + block])
        out = np.zeros((n, min(block, len(common) - low)), np.float32)
        out[row[a:b], at[a:b] - low] = 1
        return out

    for low in range(0, len(common), block):
        one = texts_with(low)
        of_one = np.ascontiguousarray(one.T)
        for other in range(low, len(common), block):
            two = one if other == low else texts_with(other)
            both, both_ones = of_one @ two, of_one[:, marked] @ two[marked]
            n_a, n_b = often[common[low:low + block], None], often[None, common[other:other + block]]
            y_a, y_b = ones[low:low + block, None], ones[None, other:other + block]
            counts = both, n_a - both, n_b - both, n - n_a - n_b + both
            positive = both_ones, y_a - both_ones, y_b - both_ones, label.sum() - y_a - y_b + both_ones
            enough = np.minimum.reduce(counts) >= texts
            i, j = np.nonzero(enough)
            c, y = [x[i, j] for x in counts], [x[i, j] for x in positive]
            beyond = y[0] / c[0] - y[1] / c[1] - y[2] / c[2] + y[3] / c[3]
            hit = np.abs(beyond) > least * np.sqrt(spread * sum(1 / x for x in c))
            told[common[low + i[hit]]] = told[common[other + j[hit]]] = True
    return told


def fit(first, bucket, value, label, bits: int = BITS, factors: int = 4, rounds: int = 12, batch: int = 128, rate: float = 0.08,
        decay: float = 2e-3, seed: int = 7) -> FactorizationMachine:
    """Fit by AdaGrad on the logistic loss, a batch of texts at a time.

    Only buckets that tell alone or in a pair are learned; the others stay 0, so that chance words of a few texts say nothing.
    """
    told = telling(first, bucket, label, bits) | telling_pairs(first, bucket, label, bits)
    keep = told[bucket]
    first = np.concatenate([[0], np.cumsum(keep)])[first]
    bucket, value = bucket[keep], value[keep]
    rng = np.random.default_rng(seed)
    model = FactorizationMachine(0.0, np.zeros(1 << bits, np.float32), (rng.normal(0, 0.01, (1 << bits, factors)) * told[:, None]).astype(np.float32))
    if not len(label):
        return model
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v = np.full(1 << bits, 1e-2, np.float32), np.full((1 << bits, factors), 1e-2, np.float32)
    size = np.diff(first)
    for _ in range(rounds):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            edge = np.cumsum([0, *size[some]])
            pick = np.repeat(first[some] - edge[:-1], size[some]) + np.arange(edge[-1])
            b, x = bucket[pick], value[pick]
            scaled = model.factor[b] * x[:, None]
            whole = _sums(scaled, edge)
            logit = model.bias + _sums(model.weight[b] * x, edge) + 0.5 * (whole ** 2 - _sums(scaled ** 2, edge)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[some]).astype(np.float32)
            model.bias -= rate * 0.1 * float(error.mean())
            each = np.repeat(error, size[some])[:, None]
            text = np.repeat(np.arange(len(some)), size[some])
            unique, place = np.unique(b, return_inverse=True)
            step_w, step_v = np.zeros(len(unique), np.float32), np.zeros((len(unique), factors), np.float32)
            np.add.at(step_w, place, each[:, 0] * x)
            pull = each * x[:, None] * (whole[text].astype(np.float32) - scaled)
            for f in range(factors):
                step_v[:, f] = np.bincount(place, pull[:, f], len(unique))
            step_w += decay * model.weight[unique]
            step_v += decay * model.factor[unique]
            seen_w[unique] += step_w ** 2
            seen_v[unique] += step_v ** 2
            model.weight[unique] -= rate * step_w / np.sqrt(seen_w[unique])
            model.factor[unique] -= rate * step_v / np.sqrt(seen_v[unique])
    return model
