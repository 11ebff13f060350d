"""Rule combinators: additive scores with reasons, and first-match labels."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``points`` are added and ``reason`` is listed wherever ``when`` is true."""

    when: Column
    points: int
    reason: Column | str


def as_column(value: Column | str | int | float | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def rule_score(
    rules: Iterable[Rule],
    start: Column | int = 0,
    reasons: Column | None = None,
) -> tuple[Column, Column]:
    """(total, reasons) over ``rules``; unknown predicates count as not met."""
    rules = list(rules)
    total = as_column(start)
    for rule in rules:
        total = total + F.when(rule.when, F.lit(rule.points)).otherwise(F.lit(0))
    listed = F.array_compact(F.array(*[F.when(r.when, as_column(r.reason)) for r in rules]))
    return total, listed if reasons is None else F.concat(reasons, listed)


def first_match(rules: Iterable[tuple[Column, Column | str]], otherwise=None) -> Column:
    """The label of the first predicate that holds, in the given order."""
    chain = None
    for predicate, label in rules:
        label = as_column(label)
        chain = F.when(predicate, label) if chain is None else chain.when(predicate, label)
    return chain.otherwise(as_column(otherwise))
