import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sieveline.llm.exact_spectrum import (by_remainders, coefficient_bound, largest_roots, null_vector, polynomials_modulo, primes_below,
                                          roots_above)
from sieveline.llm.whitening import whitened_components

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component string"


def plain_polynomial(matrix):
    """det(x - matrix) by the method of Faddeev and Leverrier, in fractions."""
    size = len(matrix)
    a = [[Fraction(x) for x in row] for row in matrix]
    m = [[Fraction(0)] * size for _ in range(size)]
    out = [Fraction(0)] * size + [Fraction(1)]
    for k in range(1, size + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(size)) + (out[size - k + 1] if i == j else 0) for j in range(size)] for i in range(size)]
        out[size - k] = -sum(a[i][t] * m[t][i] for i in range(size) for t in range(size)) / k
    return [int(x) for x in out]


def gram(rng, rows, size, span=9):
    y = [[rng.randint(-span, span) for _ in range(size)] for _ in range(rows)]
    return [[sum(r[i] * r[j] for r in y) for j in range(size)] for i in range(size)]


@pytest.mark.parametrize("rows, size", [(1, 1), (3, 2), (5, 5), (2, 6), (12, 9)])
def test_polynomial_is_exact(rows, size):
    matrix = gram(random.Random(size), rows, size)
    want = plain_polynomial(matrix)
    assert max(map(abs, want)) <= coefficient_bound(matrix)
    primes = primes_below(1 << 31, (2 * coefficient_bound(matrix) + 1).bit_length() // 30 + 2)
    assert by_remainders(primes, polynomials_modulo(matrix, primes).tolist()) == want


def test_polynomial_of_sparse_matrices():
    for matrix in ([[2, 0, 0], [0, 2, 0], [0, 0, 5]], [[1, 0, 1], [0, 0, 0], [1, 0, 1]], [[0, 0], [0, 0]]):
        primes = primes_below(1 << 31, 4)
        assert by_remainders(primes, polynomials_modulo(matrix, primes).tolist()) == plain_polynomial(matrix)


def test_roots_and_their_number():
    poly = plain_polynomial([[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 7, 0], [0, 0, 0, 0]])
    assert [roots_above(poly, x, 0) for x in (0, 1, 2, 6, 7)] == [3, 3, 1, 1, 0]
    assert [Fraction(a, 2 ** b) for a, b in largest_roots(poly, 4, 12)] == [7, 2, 2]
    (at, bits), = largest_roots([-2, 0, 1], 1, 2)
    assert 0 <= Fraction(at, 2 ** bits) ** 2 - 2 < Fraction(1, 2 ** (bits - 2)) and bits > 300


def test_null_vectors_of_repeated_roots():
    matrix = [[3, 1, 1], [1, 3, 1], [1, 1, 3]]  # 5, 2, 2
    vectors = []
    for root in largest_roots(plain_polynomial(matrix), 3, 9):
        vectors.append(null_vector(matrix, root, vectors))
    v = np.array([[float(x) for x in row] for row in vectors])
    assert np.abs(v @ v.T - np.eye(3)).max() < 1e-15
    assert np.abs(np.array(matrix) @ v.T - v.T * [5, 2, 2]).max() < 1e-14


def plain_rows(rows, components=4):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    size = max((sum(len(x) == k for _, x in kept), k) for k in {len(x) for _, x in kept})[1]
    kept = [(i, x) for i, x in kept if len(x) == size]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, dtype=float) - np.array(sums) / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    top = np.argsort(-value)[:components]
    out = {}
    for i, x in kept:
        for c, t in enumerate(top, 1):
            w = (np.array(x) - np.array(sums) / n) @ vector[:, t] / math.sqrt(value[t])
            out.setdefault((i, c), []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), w, value[t] / value.sum()))
    return out


def check(got, want, limit=1e-9):
    found = {}
    for r in got:
        assert abs(r.identity_error) <= 1e-4
        found.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
    assert found.keys() == want.keys()
    signs = {}
    for key in sorted(found, key=str):
        ours, theirs = sorted(found[key], key=lambda r: r[1]), sorted(want[key], key=lambda r: r[1])
        assert [r[:2] for r in ours] == [r[:2] for r in theirs]
        for (*_, w, e), (*_, x, f) in zip(ours, theirs):
            assert abs(e / f - 1) < 1e-9
            if abs(x) > 1e-6:
                signs.setdefault(key[1], set()).add(bool((w > 0) == (x > 0)))
            assert abs(abs(w) - abs(x)) < limit * max(1, abs(x))
    assert all(len(s) == 1 for s in signs.values())


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "c") for i, v in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("seed, size", [(1, 6), (2, 17)])
def test_equals_plain_eigenvectors(spark, seed, size):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((size, size)) * 0.2
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(size) @ mixed]) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(300)] + [rows[3], rows[3], (None, rows[5][1]), (None, rows[5][1])]
    odd = [(5000, None), (5001, []), (5002, [0.5] * (size + 1)), (5003, [float("nan")] + [0.0] * (size - 1)),
           (5004, [float("inf")] + [0.0] * (size - 1)), (5005, [None] + [0.0] * (size - 1)), (5006, [-0.0] * size)]
    check(whitened_components(table(spark, rows + odd)).collect(), plain_rows(rows + odd))


def test_few_vectors_have_few_components(spark):
    rows = [(1, [0.0, 0.0, 1.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0, 0.0, 1.0])]
    got = whitened_components(table(spark, rows)).collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (2, 1), (3, 1)}
    assert sorted(abs(r.whitened) for r in got) == [1.0, 1.0, 1.0] and {r.explained for r in got} == {1.0}
    assert {r.deviation for r in got} == {256 ** 2}


def test_no_rows_without_spread(spark):
    assert whitened_components(table(spark, [])).count() == 0
    assert whitened_components(table(spark, [(1, None)])).count() == 0
    assert whitened_components(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0


def test_large_entries_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2 ** 24)) for _ in range(3)]) for i in range(40)]
    xs = [[math.floor(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*xs)]
    want = {i: sum((40 * a - s) ** 2 for a, s in zip(x, sums)) for (i, _), x in zip(rows, xs)}
    got = {r.vec_id: r.deviation for r in whitened_components(table(spark, rows)).collect()}
    assert got == {i: v if v < 2 ** 63 else None for i, v in want.items()}
