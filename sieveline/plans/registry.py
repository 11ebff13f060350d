"""Query registration. A query gets the bound tables and returns a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_views(sql: str, recursive: bool = False) -> str:
    """``sql`` behind the common table expressions it mentions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    starts_plain = re.match(r"\s*(SELECT|FROM)\b", sql, re.I)
    word = "WITH RECURSIVE" if recursive else "WITH"
    if not head:
        return sql if starts_plain else f"{word} {sql}"
    return f"{word} {head} {sql}" if starts_plain else f"{word} {head}, {sql}"


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register ``fn(tables)`` under ``name``, with its SQL where SQL can express it."""
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql, recursive)
        return fn
    return register
