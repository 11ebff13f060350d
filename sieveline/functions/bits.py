"""Fingerprints as packed 64-bit words, so that overlap is a few AND + popcount steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def word_count(n_bits: int) -> int:
    return -(-n_bits // WORD)


def pack_bits(positions: Column, n_bits: int) -> Column:
    """``array<int>`` of on-bit positions to ``array<bigint>`` words."""

    def word(w: int) -> Column:
        own = F.filter(positions, lambda b: F.floor(b / WORD) == w)
        return F.aggregate(
            own,
            F.lit(0).cast("bigint"),
            lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (b % WORD).cast("int"))),
        )

    return F.array(*[word(w) for w in range(word_count(n_bits))])


def overlap(a: Column, b: Column, n_bits: int) -> Column:
    """Number of bits set in both; unrolled so that it compiles into the join loop."""
    return sum(
        (F.bit_count(a[w].bitwiseAND(b[w])) for w in range(1, word_count(n_bits))),
        F.bit_count(a[0].bitwiseAND(b[0])),
    )
