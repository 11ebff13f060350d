"""Leading eigenvalues and eigenvectors of a symmetric integer matrix, without rounding until the end.

The characteristic polynomial is found modulo many primes (reduction to Hessenberg form, then the recurrence over its
leading blocks) and put together by Chinese remaindering; a bound on its coefficients says how many primes make it exact.
All its roots are real, so the number of roots above a point is the number of sign changes of the polynomial moved there.
Roots are isolated by halving and then refined by the sign of the polynomial alone, all in integers. Components
are the null space of the matrix less its root, by inverse iteration with many decimal digits.

Everything here is as large as the dimension of the vectors, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal, localcontext

import numpy as np

#: Binary digits of a root below the leading digit of the largest one.
BITS = 320
#: Decimal digits of inverse iteration.
DIGITS = 110


def primes_below(limit: int, n: int) -> list[int]:
    """The ``n`` largest primes below ``limit`` (at most 2**31, so that products fit 64 bits)."""
    width = max(4000, 40 * n)
    low = limit - width
    sieve = np.ones(width, dtype=bool)
    for p in range(2, math.isqrt(limit) + 1):
        sieve[-low % p::p] = False
    found = (np.flatnonzero(sieve)[::-1] + low).tolist()
    if len(found) < n:
        raise ValueError("more primes wanted than lie in the range searched")
    return found[:n]


def coefficient_bound(matrix: Sequence[Sequence[int]]) -> int:
    """No coefficient of the characteristic polynomial of a positive semidefinite matrix is larger."""
    # coefficients are elementary symmetric functions of the eigenvalues, which sum to the trace
    size, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max([1] + [math.comb(size, k) * trace ** k // size ** k + 1 for k in range(1, size + 1)])


def _inverse(values: np.ndarray, primes: np.ndarray) -> np.ndarray:
    return np.array([pow(int(v), -1, int(p)) if v else 0 for v, p in zip(values, primes, strict=True)], dtype=np.int64)


def polynomials_modulo(matrix: Sequence[Sequence[int]], primes: Sequence[int]) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo each prime, one row a prime, the constant first."""
    p = np.array(primes, dtype=np.int64)
    size, many = len(matrix), len(primes)
    h = np.array([[[x % q for x in row] for row in matrix] for q in primes], dtype=np.int64).reshape(many, size, size)
    every, mod, mod2 = np.arange(many), p[:, None], p[:, None, None]
    for k in range(1, size - 1):
        pivot = k + (h[:, k:, k - 1] != 0).argmax(axis=1)  # some row below the diagonal that is not zero there, or row k
        rows = h[every, pivot].copy()
        h[every, pivot], h[:, k] = h[:, k].copy(), rows
        columns = h[every, :, pivot].copy()
        h[every, :, pivot], h[:, :, k] = h[:, :, k].copy(), columns
        factor = h[:, k + 1:, k - 1] * _inverse(h[:, k, k - 1], p)[:, None] % mod
        h[:, k + 1:] = (h[:, k + 1:] - factor[:, :, None] * h[:, k, None, :] % mod2) % mod2
        added = np.zeros((many, size), dtype=np.int64)
        for j in range(size - k - 1):
            added = (added + factor[:, j, None] * h[:, :, k + 1 + j]) % mod
        h[:, :, k] = (h[:, :, k] + added) % mod
    blocks = [np.zeros((many, size + 1), dtype=np.int64)]
    blocks[0][:, 0] = 1
    for k in range(size):
        new = np.zeros((many, size + 1), dtype=np.int64)
        new[:, 1:] = blocks[k][:, :-1]
        new = (new - h[:, k, k, None] * blocks[k]) % mod
        below = np.ones(many, dtype=np.int64)
        for i in range(k - 1, -1, -1):
            below = below * h[:, i + 1, i] % p
            new = (new - (below * h[:, i, k] % p)[:, None] * blocks[i]) % mod
        blocks.append(new)
    return blocks[size]


def by_remainders(primes: Sequence[int], remainders: Sequence[Sequence[int]]) -> list[int]:
    """Signed integers with the given remainders (one row a prime), each less than half the product of the primes."""
    product = math.prod(primes)
    weights = [(product // q) * pow(product // q, -1, q) for q in primes]
    out = []
    for column in zip(*remainders, strict=True):
        value = sum(w * int(r) for w, r in zip(weights, column, strict=True)) % product
        out.append(value - product if 2 * value > product else value)
    return out


def _moved(poly: Sequence[int], at: int, bits: int) -> list[int]:
    """Coefficients, up to a positive factor, of the polynomial at x + at / 2**bits."""
    size = len(poly) - 1
    out = [c << bits * (size - k) for k, c in enumerate(poly)]  # roots scaled by 2**bits
    for i in range(size):
        for k in range(size - 1, i - 1, -1):
            out[k] += at * out[k + 1]
    return out


def roots_above(poly: Sequence[int], at: int, bits: int) -> int:
    """How many roots lie above at / 2**bits, repeated ones as often as they come. All roots must be real."""
    signs = [c > 0 for c in _moved(poly, at, bits) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: Sequence[int], at: int, bits: int) -> int:
    value, scale = 0, 0
    for c in reversed(poly):
        value = value * at + (c << bits * scale)
        scale += 1
    return (value > 0) - (value < 0)


def largest_roots(poly: Sequence[int], n: int, most: int) -> list[tuple[int, int]]:
    """The ``n`` largest roots that are above zero, as (numerator, bits): within 1 / 2**bits above the root.

    ``most`` is an upper bound of the roots. Equal roots come as often as they are repeated.
    """
    bits = max(0, BITS - most.bit_length())
    positive = roots_above(poly, 0, 0)
    out: list[tuple[int, int]] = []
    for rank in range(1, min(n, positive) + 1):
        low, high, scale = 0, most, 0  # rank-th root in (low, high] / 2**scale
        above_low, above_high = positive, 0
        while scale < bits or high - low > 1:
            if high - low <= 1:
                low, high, scale = 2 * low, 2 * high, scale + 1
            middle = (low + high) // 2
            if above_low - above_high == 1:
                # one root left: the sign changes where it lies
                here = _sign(poly, middle, scale)
                if here == 0:
                    out.append((middle, scale))
                    break
                inside = 1 if here == (-1) ** above_high else 0
                above = above_high + 1 - inside
            else:
                above = roots_above(poly, middle, scale)
            if above >= rank:
                low, above_low = middle, above
            else:
                high, above_high = middle, above
        else:
            out.append((high, scale))
    return out


def null_vector(matrix: Sequence[Sequence[int]], root: tuple[int, int], others: Sequence[Sequence[Decimal]], rounds: int = 3) -> list[Decimal]:
    """A unit vector of the null space of the matrix less ``root``, at right angles to ``others``."""
    size = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        scale = Decimal(max(1, max(abs(x) for row in matrix for x in row)))
        tiny = Decimal(10) ** (-DIGITS + 20)
        # the shift lies beside the root, so that the system can be solved
        shift = Decimal(root[0]) / Decimal(2) ** root[1] / scale * (1 + tiny)
        a = [[Decimal(x) / scale - (shift if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)]
        swaps = list(range(size))
        for k in range(size):
            best = max(range(k, size), key=lambda i: abs(a[i][k]))
            a[k], a[best], swaps[k] = a[best], a[k], best
            if a[k][k] == 0:
                a[k][k] = tiny
            for i in range(k + 1, size):
                f = a[i][k] / a[k][k]
                a[i][k] = f
                if f:
                    row, top = a[i], a[k]
                    for j in range(k + 1, size):
                        row[j] -= f * top[j]
        random = np.random.default_rng(12 + len(others)).standard_normal(size)
        vector = [Decimal(float(x)) for x in random]
        for turn in range(rounds + 1):
            if turn:
                for k in range(size):  # all swaps of rows first: factors were swapped along with their rows
                    vector[k], vector[swaps[k]] = vector[swaps[k]], vector[k]
                for k in range(size):
                    vector[k] -= sum((a[k][j] * vector[j] for j in range(k)), Decimal(0))
                for k in range(size - 1, -1, -1):
                    vector[k] = (vector[k] - sum((a[k][j] * vector[j] for j in range(k + 1, size)), Decimal(0))) / a[k][k]
            for _ in range(2):
                for other in others:
                    along = sum((x * y for x, y in zip(vector, other, strict=True)), Decimal(0))
                    vector = [x - along * y for x, y in zip(vector, other, strict=True)]
                length = sum((x * x for x in vector), Decimal(0)).sqrt()
                vector = [x / length for x in vector]
        lead = max(range(size), key=lambda i: (abs(vector[i]), -i))
        return [x if vector[lead] > 0 else -x for x in vector]


def quotient(value: tuple[int, int], divisor: int) -> float:
    """value / divisor to the nearest double, for integers of any length."""
    return value[0] / (divisor << value[1])
