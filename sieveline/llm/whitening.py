"""Whitening of embeddings along the exact principal components of their scatter.

Entries are turned into integers, x = floor(256 * c). The vectors that differ are the fit list; the sums of their entries and of
all products of two entries are added up exactly in the tasks, and only these (as many as the dimension squared) reach
the driver. The integer scatter's characteristic polynomial is found modulo primes, which are spread over tasks
(``exact_spectrum``). Every row is then projected on the components in its own task.

Left out are rows whose vector is null, has null, infinite or NaN entries, no entry, or another number of entries than most
vectors of the table (ties: the larger number). Rows with a null vec_id stay. Products beyond the long range saturate before
they are counted, as Spark's floor does. Components with an eigenvalue of zero have no whitening and are not given, so a fit list of one vector
gives no rows. A deviation beyond the long range is null. Repeated rows are given as often as they come. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import cut_lineage

from .exact_spectrum import by_remainders, coefficient_bound, largest_roots, null_vector, polynomials_modulo, primes_below, quotient
from .frames import ship_package

SCALE = 256
COMPONENTS = 4
#: Numbers of a task's sums are sent in pieces of so many bits, which Spark can add without overflow.
PIECE = 40
PRIMES_A_TASK = 16


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that remain, with integer entries."""
    vector = F.col("embedding")
    good = vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = embeddings.where(good).select(
        F.col("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE)))).alias("x"))
    sizes = embeddings.where(good).groupBy(F.size(vector).alias("size")).count()
    usual = sizes.agg(F.max_by("size", F.struct("count", "size"))).scalar()
    return rows.where(F.size("x") == usual)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the entries and of their products, exactly; as Python integers if 64 bits might not do."""
    largest = max(abs(int(x.max())), abs(int(x.min())))
    if len(x) * largest ** 2 < 2 ** 53:
        y = x.astype(np.float64)
        return x.sum(axis=0).astype(object), np.rint(y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.sum(axis=0), y.T @ y


def scatter_sums(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums of the entries and of the products of two entries of column ``x``."""
    def run(batches):
        rows, one, two = 0, None, None
        for batch in batches:
            x = _matrix(batch.column("x"))
            for at in range(0, len(x), 4096):
                a, b = _sums(x[at:at + 4096])
                one, two = (a, b) if one is None else (one + a, two + b)
            rows += len(x)
        if one is None:
            return
        d = len(one)
        cells = [(-1, -1, rows)] + [(-1, i, int(one[i])) for i in range(d)] + [(i, j, int(two[i, j])) for i in range(d) for j in range(i, d)]
        out = []
        for i, j, value in cells:
            sign, value, piece = (1 if value >= 0 else -1), abs(value), 0
            while value or piece == 0:
                out.append((i, j, piece, sign * (value & (1 << PIECE) - 1)))
                value, piece = value >> PIECE, piece + 1
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["i", "j", "piece", "value"]).astype(
            {"i": "int32", "j": "int32", "piece": "int32", "value": "int64"}), preserve_index=False)

    parts = vectors.select("x").mapInArrow(run, "i int, j int, piece int, value long")
    total: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "piece").agg(F.sum("value").alias("value")).collect():  # the dimension squared, a few pieces each
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (r.value << PIECE * r.piece)
    d = max((j for i, j in total if i < 0), default=-1) + 1
    return total.get((-1, -1), 0), [total[-1, i] for i in range(d)], [[total[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


def scatter(n: int, sums: Sequence[int], products: Sequence[Sequence[int]]) -> list[list[int]]:
    """n squared times the covariance: the products of n * x - sums, divided by n, which leaves no remainder."""
    return [[n * products[i][j] - sums[i] * sums[j] for j in range(len(sums))] for i in range(len(sums))]


def characteristic_polynomial(spark, matrix: Sequence[Sequence[int]]) -> list[int]:
    """Coefficients of det(x - matrix), the constant first; the primes are spread over tasks."""
    need = 2 * coefficient_bound(matrix) + 1
    primes = primes_below(1 << 31, need.bit_length() // 30 + 2)

    def run(parts):
        for part in parts:
            p = part["p"].tolist()
            yield pd.DataFrame({"p": p, "c": polynomials_modulo(matrix, p).tolist()})

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // PRIMES_A_TASK))
    found = {r.p: r.c for r in rows.mapInPandas(run, "p long, c array<long>").collect()}
    return by_remainders(primes, [found[p] for p in primes])


def principal_components(spark, matrix: Sequence[Sequence[int]], n: int, components: int) -> tuple[np.ndarray, list[float], list[float]]:
    """Unit eigenvectors (one a row) of matrix / n**2, their eigenvalues and each one's share of the trace."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if trace == 0:
        return np.zeros((0, len(matrix))), [], []
    common = math.gcd(*(abs(x) for row in matrix for x in row))
    small = [[x // common for x in row] for row in matrix]
    roots = largest_roots(characteristic_polynomial(spark, small), components, trace // common + 1)
    vectors: list[list] = []
    for root in roots:
        vectors.append(null_vector(small, root, vectors))
    values = [quotient((root[0] * common, root[1]), n * n) for root in roots]
    return (np.array([[float(x) for x in v] for v in vectors]).reshape(len(roots), len(matrix)), values,
            [quotient((root[0] * common, root[1]), trace) for root in roots])


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """n * x - sums as doubles, and the sums of their squares, exactly."""
    largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(int(s)) for s in sums) if x.size else 0
    if x.shape[-1] * largest ** 2 < 2 ** 63:
        y = n * x - sums.astype(np.int64)
        return y.astype(np.float64), (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - sums
    return y.astype(np.float64), [v if v < 2 ** 63 else None for v in (y * y).sum(axis=1).tolist()]


def whitened_components(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every remaining row and component."""
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = integer_vectors(embeddings)
    fit = cut_lineage(rows.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    n, sums, products = scatter_sums(fit)
    matrix = scatter(n, sums, products)
    vectors, values, shares = principal_components(spark, matrix, n, components) if n else (np.zeros((0, 0)), [], [])
    sums = np.array(sums, dtype=object)
    fields = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not values:
        return spark.createDataFrame([], fields)
    weights = (vectors / np.sqrt(values)[:, None]).T / n
    count = len(values)

    def moments(batches):
        total = np.zeros((count + 1, count + 1))
        for batch in batches:
            y, _ = _deviation(_matrix(batch.column("x")), n, sums)
            w = np.concatenate([y @ weights, np.ones((len(y), 1))], axis=1)
            total += w.T @ w
        cells = [(i, j, float(total[i, j])) for i in range(count + 1) for j in range(count + 1)]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(cells, columns=["i", "j", "value"]).astype({"i": "int32", "j": "int32"}), preserve_index=False)

    # whitened values are centred already; what is left of their means by rounding is taken off as well
    second = np.zeros((count + 1, count + 1))
    for r in fit.mapInArrow(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        second[r.i, r.j] = r.value / n
    spread = second[:count, :count] - np.outer(second[:count, count], second[:count, count])
    error = float(np.abs(spread - np.eye(count)).max())

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            y, deviation = _deviation(x, n, sums)
            size = len(x)
            taken = pa.array(np.repeat(np.arange(size), count))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(taken), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                 pa.array(np.full(size * count, n, dtype=np.int64)), pa.array(deviation, pa.int64()).take(taken),
                 pa.array((y @ weights).ravel()), pa.array(np.tile(shares, size)), pa.array(np.full(size * count, error))],
                [f.split()[0] for f in fields.split(", ")])

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(project, fields)
