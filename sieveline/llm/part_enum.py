"""PartEnum signatures for sets with a Jaccard similarity of 0.8 or more.

The domain of elements is partitioned by hashing. Two sets of a and b elements with a similarity of 0.8
differ in at most k = (a + b) // 9 elements. Sizes are put into bands by the larger set of a pair; a
set takes part in its own band and in the next one if a partner may lie there.

* Bands of small sets have one block of k + 2 parts; every choice of two parts gives a signature. The
  differences touch at most k parts, so some choice is equal in both sets.
* Other bands have many blocks of three parts; every choice of two parts of a block gives a signature.
  At most k // 2 blocks hold two differences or more, so among k // 2 + 1 + spare blocks more than ``spare``
  have at most one, and one choice of two parts of each is equal in both sets.

Equal choices may be empty, which says nothing. They are left out, without loss: if all elements of a
block lie outside a choice, the block is parted again by another hash, in both sets alike, until the
equal choice holds something. For blocks of one and two elements, single elements are signatures too, so
that one element is found beside two. A set with more than ``spare`` blocks of up to one element is
signed again with another seed, so that a pair is only at its end when one of the two has enough full blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from .text_words import mix

RATIO = 1.4
#: Upper sizes of the bands with one block; k is 1 to 6 in them.
SINGLE = (8, 13, 17, 22, 26, 31)


def _bands(most: int) -> list[int]:
    out = list(SINGLE)
    while out[-1] < most:
        out.append(int(out[-1] * RATIO))
    return out


def _spare(upper: np.ndarray) -> np.ndarray:
    return 1 + upper * 75 // 9000


def _u(value: int) -> np.uint64:
    return np.uint64(value & ((1 << 64) - 1))


def _tag(*parts) -> np.ndarray:
    out = np.full(1, 0x517CC1B727220A95, dtype=np.uint64)
    for part in parts:
        out = mix(np.asarray(part, dtype=np.uint64) + out * np.uint64(31))
    return out


_ALL = (1 << 64) - 1


def _mix(value: int) -> int:
    """``mix`` of one Python integer."""
    value ^= value >> 30
    value = value * 0xBF58476D1CE4E5B9 & _ALL
    value ^= value >> 27
    value = value * 0x94D049BB133111EB & _ALL
    return value ^ value >> 31


def _again(elements: np.ndarray, tag: int, parts: int, level: int, out: list[int]) -> None:
    """Signatures of one block that is parted again, as often as a choice of two parts is empty.

    With three parts, two of them are what is left without the third.
    """
    values = elements.tolist()
    while True:
        level += 1
        shift = level * 0x9E3779B97F4A7C15
        sums, held = [0] * parts, [0] * parts
        for value in values:
            part = _mix(value + shift & _ALL) % parts
            sums[part] += _mix(value)
            held[part] += 1
        empty = False
        for number, (one, two) in enumerate(combinations(range(parts), 2)):
            if held[one] + held[two]:
                out.append(_mix((sums[one] + sums[two] + tag) * 31 + level * 1009 + number & _ALL))
            else:
                empty = True
        if not empty:
            return


def signatures(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of several sets, with the number of the set each is of.

    Set ``i`` has the distinct elements ``keys[first[i]:first[i + 1]]``. Sets of fewer than four elements
    are like no other set, and have none.
    """
    size = np.diff(first)
    bands = _bands(int(size.max() * 5 // 4) + 1 if len(size) else 1)
    sets, uppers = [], []
    lower = 0
    for upper in bands:
        inside = np.flatnonzero((size >= 4) & (size <= upper) & (size * 5 // 4 > lower))
        sets.append(inside)
        uppers.append(np.full(len(inside), upper))
        lower = upper
    task_set, task_upper = np.concatenate(sets), np.concatenate(uppers)
    found: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    small = task_upper <= SINGLE[-1]
    for k, upper in enumerate(SINGLE, 1):
        _single(keys, first, size, task_set[task_upper == upper], upper, k, found, owner)
    pending, seed = (task_set[~small], task_upper[~small]), 0
    while len(pending[0]):
        pending = _blocks(keys, first, size, *pending, seed, found, owner)
        seed += 1
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner)


def _elements(keys, first, size, sets):
    """Elements of ``sets`` one after the other, each with its place in ``sets``."""
    count = size[sets]
    task = np.repeat(np.arange(len(sets)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return keys[first[sets][task] + within], task


def _single(keys, first, size, sets, upper, k, found, owner) -> None:
    if not len(sets):
        return
    parts = k + 2
    element, task = _elements(keys, first, size, sets)
    part = (mix(element + _u(upper)) % np.uint64(parts)).astype(np.int64)
    cell = task * parts + part
    sums = np.zeros(len(sets) * parts, dtype=np.uint64)
    np.add.at(sums, cell, mix(element))
    sums = sums.reshape(-1, parts)
    held = np.bincount(cell, minlength=len(sets) * parts).reshape(-1, parts)
    empty = np.zeros(len(sets), dtype=bool)
    for number, (one, two) in enumerate(combinations(range(parts), 2)):
        full = held[:, one] + held[:, two] > 0
        empty |= ~full
        found.append(_tag(sums[full, one] + sums[full, two], upper, number))
        owner.append(sets[full])
    for at in np.flatnonzero(empty):
        more: list[int] = []
        _again(keys[first[sets[at]]:first[sets[at] + 1]], upper, parts, 0, more)
        found.append(np.array(more, dtype=np.uint64))
        owner.append(np.full(len(more), sets[at]))


def _blocks(keys, first, size, sets, upper, seed, found, owner):
    """Signs ``sets`` over blocks of three parts; returns those that need another seed."""
    spare = _spare(upper)
    blocks = upper * 2 // 9 // 2 + 1 + spare
    own = size[sets]
    used = (own + np.minimum(upper, own * 5 // 4)) // 9 // 2 + 1 + spare
    element, task = _elements(keys, first, size, sets)
    hashed = mix(element + _u((seed + 1) * 0xD1B54A32D192ED03))
    block = ((hashed >> np.uint64(32)) * blocks[task].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    keep = block < used[task]
    element, task, block, hashed = element[keep], task[keep], block[keep], hashed[keep]
    base = np.cumsum(used) - used
    at = base[task] + block
    cell = at * 3 + (hashed % np.uint64(3)).astype(np.int64)
    total = int(used.sum())
    sums = np.zeros(total * 3, dtype=np.uint64)
    np.add.at(sums, cell, mix(element))
    sums = sums.reshape(-1, 3)
    held = np.bincount(cell, minlength=total * 3).reshape(-1, 3)
    whole_sum, whole = sums.sum(axis=1, dtype=np.uint64), held.sum(axis=1)
    of = np.repeat(np.arange(len(sets)), used)
    number = np.arange(total) - np.repeat(base, used)
    tag = _tag(upper[of], number, seed)
    lone = np.zeros(total, dtype=bool)
    for part in range(3):
        rest = whole - held[:, part]
        full = (rest > 0) & (whole > 1)
        found.append(mix((whole_sum - sums[:, part])[full] + tag[full] + _u(part * 0x632BE59BD9B4E019)))
        owner.append(sets[of[full]])
        lone |= (rest == 0) & (whole >= 2)
    if lone.any():
        order = np.argsort(at, kind="stable")
        begin = np.searchsorted(at[order], np.arange(total + 1))
        for spot in np.flatnonzero(lone):
            more: list[int] = []
            _again(element[order[begin[spot]:begin[spot + 1]]], int(tag[spot]), 3, 0, more)
            found.append(np.array(more, dtype=np.uint64))
            owner.append(np.full(len(more), sets[of[spot]]))
    single = whole[at] <= 2
    found.append(mix(element[single] + tag[at[single]] + _u(0x8CB92BA72F3D8DD7)))
    owner.append(sets[task[single]])
    thin = np.add.reduceat((whole <= 1).astype(np.int64), base)
    weak = thin > spare
    return sets[weak], upper[weak]
