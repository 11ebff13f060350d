"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are cut into blocks of a bounded number of words; each block becomes one automaton, broadcast and
held by the workers, and all documents are streamed past it. With several blocks, each is one pass over
the documents, and only documents with matches are gathered afterwards. Nothing of the documents is shuffled.

Null and empty texts have no words; items without words have no windows. Equal items are both reported.
An item with a null item_id still hits words, but is not counted. Rows with the same doc_id are told apart
by their text. Other columns of both tables are not looked at, and are kept by ``remove_contamination``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import cut_lineage

from .frames import free_name, ship_package, with_text
from .suffix_automaton import ItemAutomaton, item_words
from .text_words import row_groups

WINDOW = 10
#: Words of one automaton: about 100 MB in a worker.
BLOCK_WORDS = 200_000
#: A document of which more than this share is benchmark text is rejected.
MAX_COVERAGE = 0.5
#: Spans and documents that may be broadcast, about 16 bytes each; more are joined by a shuffle.
BROADCAST_SPANS = 500_000

_HITS = "doc_id long, text_key long, n_words long, n_hit long, item_ids array<string>, starts array<long>, ends array<long>"


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[ItemAutomaton]:
    """One automaton for each block of items. Items are fetched block by block, never all at once."""
    rows, count = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        rows.append(row)
        count += len(row[1]) // 2 + 1
        if count >= block_words:
            yield _automaton(rows, window)
            rows, count = [], 0
    if rows:
        yield _automaton(rows, window)


def _automaton(rows, window: int) -> ItemAutomaton:
    words = item_words(pa.array([r[1] for r in rows], pa.large_string()))
    spelled = [words.data[a:b].tobytes().lower() for a, b in zip(words.start, words.end, strict=True)]
    items = [(r[0], spelled[words.first[i]:words.first[i + 1]]) for i, r in enumerate(rows)]
    return ItemAutomaton(items, window, words.key)


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def _matched(docs: DataFrame, automaton: ItemAutomaton, all_rows: bool) -> DataFrame:
    """Matches of each document with one block; ``all_rows`` also gives documents without any."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        automaton = shared.value
        for batch in batches:
            for low, high in row_groups(batch.column("text")):
                part = batch.slice(low, high - low)
                words = item_words(part.column("text"))
                found: dict[int, list] = {}
                for match in automaton.matches(words):
                    row = int(np.searchsorted(words.first, match[0], side="right")) - 1
                    found.setdefault(row, []).append(match)
                rows = range(len(part)) if all_rows else sorted(found)
                out = {name: [] for name in ("n_hit", "item_ids", "starts", "ends")}
                for row in rows:
                    matches = found.get(row, [])
                    spans = _union([m[:2] for m in matches])
                    out["n_hit"].append(sum(b - a for a, b in spans))
                    out["item_ids"].append(sorted({i for m in matches for i in m[2] if i is not None}))
                    out["starts"].append([a - int(words.first[row]) for a, _ in spans])
                    out["ends"].append([b - int(words.first[row]) for _, b in spans])
                chosen = pa.array(list(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(chosen), part.column("text_key").take(chosen),
                     pa.array(np.diff(words.first).astype(np.int64)).take(chosen), pa.array(out["n_hit"], pa.int64()),
                     pa.array(out["item_ids"], pa.list_(pa.string())), pa.array(out["starts"], pa.list_(pa.int64())),
                     pa.array(out["ends"], pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n_words", "n_hit", "item_ids", "starts", "ends"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, _HITS)


def _merged(starts, ends):
    spans = _union([s for block in zip(starts, ends, strict=True) for s in zip(*block, strict=True)])
    return [a for a, _ in spans], [b for _, b in spans], sum(b - a for a, b in spans)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
                  all_rows: bool = True) -> DataFrame:
    """Words of each document inside windows of items.

    Gives doc_id, text_key (hash of the text), n_words, n_hit, item_ids, and starts and ends: the spans
    of hit words, counted in words from 0. Documents without a hit are left out unless ``all_rows``.
    """
    ship_package(docs.sparkSession)
    first, more = None, []
    for automaton in automata(benchmark, window, block_words):
        if first is None:
            first = _matched(docs, automaton, all_rows)
        else:
            more.append(cut_lineage(_matched(docs, automaton, False), "matches"))
    if first is None:
        return _matched(docs, _automaton([], window), all_rows)
    if not more:
        return first
    first = cut_lineage(first, "matches")
    gathered = first.where("n_hit > 0")
    for part in more:
        gathered = gathered.union(part)
    merged = F.udf(_merged, "struct<starts: array<long>, ends: array<long>, n_hit: long>")
    spans = (gathered.dropDuplicates(["doc_id", "text_key", "item_ids", "starts", "ends"]).groupBy("doc_id", "text_key", "n_words")
             .agg(merged(F.collect_list("starts"), F.collect_list("ends")).alias("m"),
                  F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
             .selectExpr("doc_id key_id", "text_key key_text", "n_words", "m.n_hit", "item_ids", "m.starts", "m.ends"))
    same = F.col("doc_id").eqNullSafe(F.col("key_id")) & F.col("text_key").eqNullSafe(F.col("key_text"))
    if not all_rows:
        return spans.withColumnsRenamed({"key_id": "doc_id", "key_text": "text_key"})
    rest = first.where("n_hit = 0").join(spans.select("key_id", "key_text"), same, "left_anti")
    whole = (first.select("doc_id", "text_key").join(spans, same)
             .select("doc_id", "text_key", "n_words", "n_hit", "item_ids", "starts", "ends"))
    return rest.union(whole)


def _without_spans(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    words = item_words(pa.array(text, pa.large_string()))
    out = []
    for row, value in enumerate(text):
        raw, kept, at = value.encode(), [], 0
        first, base = int(words.first[row]), int(words.offset[row])
        for a, b in zip(starts[row], ends[row], strict=True):
            kept.append(raw[at:int(words.start[first + a]) - base])
            at = int(words.end[first + b - 1]) - base
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pd.Series(out)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
                         block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without benchmark text.

    Every span of hit words goes, from the first letter of its first word to the last of its last. A
    document of which more than ``max_coverage`` is hit is left out. Other rows stay as they are.
    """
    found = cut_lineage(contamination(docs, benchmark, window, block_words, all_rows=False).where("n_hit > 0"), "contaminated")
    rows, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    id_, key, starts, ends, share = (free_name(docs, x) for x in ("hit_doc", "hit_text", "hit_starts", "hit_ends", "hit_share"))
    spans = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("starts").alias(starts),
                         F.col("ends").alias(ends), (F.col("n_hit") / F.col("n_words")).alias(share)).dropDuplicates([id_, key])
    if rows + total <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    joined = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key)), "left")
    joined = joined.where(F.col(share).isNull() | (F.col(share) <= max_coverage))
    hit = F.col(share).isNotNull()
    cut = F.pandas_udf(_without_spans, "string")
    text = F.when(hit, cut(F.when(hit, F.col("text")).otherwise(""), F.coalesce(starts, F.array().cast("array<long>")),
                            F.coalesce(ends, F.array().cast("array<long>")))).otherwise(F.col("text"))
    return with_text(joined, text).select(*docs.columns)
