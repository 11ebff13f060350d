"""String helpers that stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """True where ``text`` holds one of ``terms`` as a substring; case is the caller's."""
    return any_of([F.contains(text, F.lit(t)) for t in terms])


def contains_word(text: Column, terms: Sequence[str]) -> Column:
    """Like :func:`contains_any`, but only between word boundaries."""
    pattern = "|".join(_quote(t) for t in terms)
    return text.rlike(rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])")


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms found in ``text``, in the order of ``terms``."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]))


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def joined(*parts: Column) -> Column:
    """Parts separated by single spaces; an absent part counts as empty."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def normalise_ligand(ligand: Column) -> Column:
    """Drop the pose-file suffix some producers leave on ligand ids."""
    return F.regexp_replace(ligand, r"(_out)?(\.pdbqt)?$", "")


def safe_name(name: Column) -> Column:
    """File- and job-name form of an id."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")


def fixed_text(value: Column, digits: int) -> Column:
    """``value`` with a fixed number of decimals, rounded by its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal form instead: 12.35 lies below its decimal form, but becomes 12.4. Here
    only a product that looks like a tie needs more care, and its exact remainder (Dekker) tells the side.
    """
    scale = F.lit(float(10 ** digits))
    scaled = value * scale
    split = value * F.lit(134217729.0)
    high = split - (split - value)
    rest = (scale * high - scaled) + scale * (value - high)
    below = F.floor(scaled).cast("double")
    whole = F.when((scaled - below == 0.5) & (rest != 0), below + (rest > 0).cast("double")).otherwise(F.rint(scaled))
    return F.format_string(f"%.{digits}f", whole / scale)


def percent_text(fraction: Column, digits: int = 1) -> Column:
    """A fraction as percent text; blank only where it is unknown."""
    return F.when(fraction.isNull(), F.lit("")).otherwise(fixed_text(fraction * 100, digits))


def _quote(term: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)
