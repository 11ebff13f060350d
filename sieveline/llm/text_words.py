"""Words of Arrow text columns as numpy arrays.

A whole column is cut into words and every word gets a 64-bit key without making a Python object per
word. Texts are taken a window of bytes at a time, so that the arrays stay small for very long texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words of the class [^\\x20\\x09-\\x0D].
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of the class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] once A-Z are in lower case.
PLAIN = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
NOT_SPACE = np.array([b not in SPACES for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
SAME = np.arange(256, dtype=np.uint8)

WINDOW = 1 << 20
_random = np.random.default_rng(20240501)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    size = max(n, WINDOW)
    if size not in _POWERS:
        pair = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        if size > WINDOW:  # a single word longer than the window: not worth keeping
            return pair[0], pair[1]
        _POWERS[size] = (pair[0], pair[1])
    return _POWERS[size]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_groups(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each; a longer text has a range of its own."""
    _, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


@dataclass
class Words:
    """Words of consecutive texts: text ``i`` has words ``first[i]`` to ``first[i + 1]``.

    Its bytes are ``data[offset[i]:offset[i + 1]]``.
    """

    data: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def scan(column: pa.Array, word_byte: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """Every word of every text, with byte offsets into ``data`` and a key of its folded bytes."""
    data, offsets = text_bytes(column)
    low, high = int(offsets[0]), int(offsets[-1])
    starts, ends, keys = [], [], []
    at = low
    while at < high:
        stop = min(at + WINDOW, high)
        if stop < high:
            stop = _cut(data, at, stop, high, word_byte[fold], offsets)
        folded = fold[data[at:stop]]
        inside = word_byte[folded]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:]
        edge = offsets[np.searchsorted(offsets, at, "left"):np.searchsorted(offsets, stop, "left")] - at
        begins[edge] = inside[edge]
        edge = edge[edge > 0] - 1
        finishes[edge] = inside[edge]
        start = np.flatnonzero(begins)
        end = np.flatnonzero(finishes) + 1
        if len(start):
            power, inverse = powers(stop - at)
            sums = np.zeros(stop - at + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[folded] * power[:stop - at], out=sums[1:])
            keys.append(mix((sums[end] - sums[start]) * inverse[start]))
            starts.append(start + at)
            ends.append(end + at)
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    return Words(data, offsets, np.searchsorted(start, offsets), start, end, key)


def _cut(data, at, stop, high, is_word, offsets) -> int:
    """A place near ``stop`` where no word is split."""
    row = int(np.searchsorted(offsets, stop, "right")) - 1
    if offsets[row] > at:
        return int(offsets[row])
    gaps = np.flatnonzero(~is_word[data[at:stop]])
    if len(gaps) and gaps[-1] > 0:
        return at + int(gaps[-1])
    while stop < high:
        ahead = min(stop + WINDOW, high)
        gaps = np.flatnonzero(~is_word[data[stop:ahead]])
        if len(gaps):
            return stop + int(gaps[0])
        stop = ahead
    return high


_PLACES = np.array([0x9DDFEA08EB382D69, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F,
                    0xD6E8FEB86659FD93], dtype=np.uint64)


def shingle_keys(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of ``size`` words and the text each lies in.

    A text of fewer words, but not none, has one key for its whole sequence.
    """
    row = words.row()
    count = np.diff(words.first)
    total = len(words.key) - size + 1
    if total > 0:
        keep = row[:total] == row[size - 1:]
        keys = np.zeros(total, dtype=np.uint64)
        for place in range(size):
            keys += words.key[place:place + total] * _PLACES[place]
        keys, rows = mix(keys[keep]), row[:total][keep]
    else:
        keys, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.full(len(short), 0x1234567, dtype=np.uint64) * count[short].astype(np.uint64)
        for place in range(size - 1):
            has = count[short] > place
            extra[has] += words.key[words.first[short[has]] + place] * _PLACES[place]
        keys = np.concatenate([keys, mix(extra)])
        rows = np.concatenate([rows, short])
    return keys, rows
