"""Operators bound to the benchmark tables, each with the SQL it must agree with."""

from . import compounds, hits, ledger, similarity, sources, streams, targets  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
