"""Substring deduplication by hashing lines or paragraphs, then passages of any place.

Each unit is normalised (its words by the class of ``text_words.PLAIN``, in lower case, one blank apart) and
hashed to 128 bits. Digests are grouped over all documents; the occurrence that ranks first, by doc_id and then by its
place in the text, is kept, and all others are removed. Offsets are those of the original text, in characters.

Units of fewer than ``min_words`` words are never removed. Null and empty texts have no units. A null doc_id
ranks last. Repeated rows of one document are one document: its units are judged once, for all its
rows. Rows with the same doc_id and different texts are told apart by their text. Other columns are not looked at,
and ``remove_repeated_units`` keeps them.

What the units leave is searched for repeated passages: runs of ``passage_words`` words, wherever they stand in a line
and over line edges. Every run that occurs more than once stays where it ranks first, by doc_id and then by its place;
elsewhere its words are cut out. Only runs near a repeated anchor are compared. Anchors are the runs of half that
length with the lowest key among all halves of a passage, so equal passages have equal anchors and none is missed.
Runs are compared by 128 bits, made of 64-bit keys of their words.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import cut_lineage

from .frames import free_name, ship_package, with_text
from .text_words import LOWER, PLAIN, SPACES, Words, mix, powers, row_groups, scan

MIN_WORDS = 10
PASSAGE_WORDS = 50
#: Separators of units. A paragraph ends at blank lines.
UNITS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*(?:\n[ \t]*)+")}
#: Occurrences of one key that are joined with the kept one in one slice; a key of more is met in several.
SLICE_ROWS = 20_000
#: Numbers in a list of what to remove, up to which it is broadcast (8 bytes each); a longer one meets the texts by a shuffle.
BROADCAST_NUMBERS = 1_000_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if PLAIN[b] else SPACES[0] for b in range(256))
_JOINT = {"line": "\n", "paragraph": "\n\n"}
_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UNIT = "doc_id long, text_key long, unit int, start long, end long, digest_a long, digest_b long"


def split_units(text: str, unit: str = "line") -> list[tuple[int, int]]:
    """(start, end) of the units of ``text``."""
    out, at = [], 0
    for gap in UNITS[unit].finditer(text):
        out.append((at, gap.start()))
        at = gap.end()
    return [*out, (at, len(text))]


def unit_digest(unit: str, min_words: int) -> bytes | None:
    """The digest of a unit; None if it is too short."""
    words = unit.encode().translate(_FOLD).split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if len(words) >= max(min_words, 1) else None


def hashed_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, unit, start, end, digest_a, digest_b) of all units that are long enough."""
    ship_package(docs.sparkSession)
    names = [x.split()[0] for x in _UNIT.split(", ")]
    types = [pa.int32(), *[pa.int64()] * 4]

    def run(batches):
        for batch in batches:
            rows, out = [], [[] for _ in types]
            for row, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                for number, (start, end) in enumerate(split_units(text, unit)):
                    digest = unit_digest(text[start:end], min_words)
                    if digest is not None:
                        rows.append(row)
                        for column, x in zip(out, (number, start, end, int.from_bytes(digest[:8], "big", signed=True),
                                                   int.from_bytes(digest[8:], "big", signed=True)), strict=True):
                            column.append(x)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(taken), batch.column("text_key").take(taken),
                                              *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names)

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, _UNIT)


def _with_kept(rows: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with the written table ``kept``, which has each key once and its number ``n`` of rows.

    Only keys of more than ``SLICE_ROWS`` rows are cut into slices, as many as their rows ask for.
    """
    hot = cut_lineage(kept.where(F.col("n") > SLICE_ROWS).select(*on, F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("slices")), "hot")
    if hot.isEmpty():
        return rows.join(kept.drop("n"), on)
    one = F.coalesce("slices", F.lit(1))
    dealt = rows.join(hot, on, "left").withColumn("slice", F.pmod(F.xxhash64(*rows.columns), one).cast("int")).drop("slices")
    spread = kept.join(hot, on, "left").withColumn("slice", F.explode(F.sequence(F.lit(0), one - 1))).drop("slices", "n")
    return dealt.join(spread, [*on, "slice"]).drop("slice")


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """Every unit to remove, with its offsets and the occurrence that is kept."""
    units = cut_lineage(hashed_units(docs, unit, min_words), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "unit", "text_key", "start")
    # repeated rows have the same rank, and count as one
    kept = cut_lineage(units.groupBy("digest_a", "digest_b").agg(F.min(rank).alias("kept"), F.max(rank).alias("other"), F.count(F.lit(1)).alias("n"))
                       .where("kept <> other or not (kept.doc_id <=> other.doc_id)").drop("other"), "kept")
    return (_with_kept(units, kept, ["digest_a", "digest_b"])
            .where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("unit") == F.col("kept.unit"))
                     & (F.col("text_key") == F.col("kept.text_key"))))
            .select("doc_id", "text_key", "unit", "start", "end", F.col("kept.doc_id").alias("kept_doc_id"),
                    F.col("kept.unit").alias("kept_unit"), F.col("kept.start").alias("kept_start")).distinct())


def _list_by_text(gone: DataFrame, values: Column, id_: str, key: str, name: str) -> tuple[DataFrame, int]:
    """The distinct ``values`` of each text, written, and how many numbers the table holds."""
    listed = cut_lineage(gone.groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.collect_set(values).alias(name)), name)
    return listed, listed.agg(F.coalesce(F.sum(F.size(name) * 2 + 2), F.lit(0))).first()[0]


def _beside_texts(texts: DataFrame, listed: DataFrame, numbers: int, same: Column, how: str) -> DataFrame:
    """``texts`` joined with a list of counted size; while it is small no text is moved."""
    return texts.join(F.broadcast(listed) if numbers <= BROADCAST_NUMBERS else listed, same, how)


def _without_units(text: pd.Series, unit: pd.Series, gone: pd.Series) -> pd.DataFrame:
    texts, starts, ends = [], [], []
    for value, kind, dropped in zip(text, unit, gone, strict=True):
        spans = split_units(value, kind)
        dropped = set(dropped)
        left = [x for number, x in enumerate(spans) if number not in dropped]
        texts.append(_JOINT[kind].join(value[a:b] for a, b in left))
        starts.append([a for a, _ in left])
        ends.append([b for _, b in left])
    return pd.DataFrame({"text": texts, "starts": starts, "ends": ends})


def _run_keys(word_keys: np.ndarray, size: int) -> np.ndarray:
    """A key of every run of ``size`` words."""
    power, inverse = powers(len(word_keys) + 1)
    sums = np.zeros(len(word_keys) + 1, dtype=np.uint64)
    np.cumsum(word_keys * power[:len(word_keys)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[:len(word_keys) - size + 1])


def _sliding(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The best of every ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        values = best(values[:-width], values[width:])
        width *= 2
    return best(values[:len(values) - (size - width)], values[size - width:])


def _passages(words: Words, size: int) -> np.ndarray:
    """Whether a run of ``size`` words that begins at a word lies in one text."""
    row = words.row()
    return row[:len(row) - size + 1] == row[size - 1:]


def anchor_places(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which an anchor begins, and its key. Each run of ``size`` words holds one at least."""
    half = (size + 1) // 2
    if len(words.key) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    keys, near = _run_keys(words.key, half), size - half + 1
    lowest = np.where(_passages(words, size), _sliding(keys, near, np.minimum), np.uint64(0))
    ends = np.zeros(near - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([ends, lowest, ends]), near, np.maximum) == keys)
    return at, keys[at]


def _anchors(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, place, anchor) of all texts; places are counted in words."""
    fields = "doc_id long, text_key long, place long, anchor long"

    def run(batches):
        for batch in batches:
            for low, high in row_groups(batch.column("text")):
                part = batch.slice(low, high - low)
                words = scan(part.column("text"), PLAIN, LOWER)
                at, key = anchor_places(words, size)
                row = np.searchsorted(words.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), part.column("text_key").take(pa.array(row)),
                                                  pa.array(at - words.first[row]), pa.array(key.view(np.int64))],
                                                 ["doc_id", "text_key", "place", "anchor"])

    return texts.select("doc_id", "text_key", "text").mapInArrow(run, fields)


def _runs_at(texts: DataFrame, size: int) -> DataFrame:
    """All runs of ``size`` words that hold one of the anchors in ``places``, with offsets and digests."""
    fields = "doc_id long, text_key long, place long, start long, end long, digest_a long, digest_b long"
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches):
        for batch in batches:
            for low, high in row_groups(batch.column("text")):
                part = batch.slice(low, high - low)
                words = scan(part.column("text"), PLAIN, LOWER)
                if len(words.key) < size:
                    continue
                near = size - (size + 1) // 2 + 1
                steps = np.zeros(len(words.key) + 1, np.int64)
                for row, places in enumerate(part.column("places")):
                    at = np.array(places.as_py(), np.int64) + words.first[row]
                    np.add.at(steps, np.maximum(at - near + 1, words.first[row]), 1)
                    np.add.at(steps, at + 1, -1)
                ok = _passages(words, size)
                at = np.flatnonzero(ok & (np.cumsum(steps)[:len(ok)] > 0))
                row = np.searchsorted(words.first, at, "right") - 1
                base = words.offset[0]
                chars = np.concatenate([[0], np.cumsum((words.data[base:words.offset[-1]] & 0xC0) != 0x80)])
                start, end = (chars[x - base] - chars[words.offset[row] - base] for x in (words.start[at], words.end[at + size - 1]))
                digests = (_run_keys(k, size)[at].view(np.int64) for k in (words.key, mix(words.key + np.uint64(0x632BE59BD9B4E019))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), part.column("text_key").take(pa.array(row)),
                                                  *(pa.array(x, pa.int64()) for x in (at - words.first[row], start, end, *digests))], names)

    return texts.select("doc_id", "text_key", "text", "places").mapInArrow(run, fields)


def repeated_passages(texts: DataFrame, size: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, text_key, start, end) of every run of ``size`` words that ranks behind an equal one.

    Of a run that overlaps the kept one, only what lies behind the kept one is given. ``texts`` has doc_id, text_key and text.
    """
    ship_package(texts.sparkSession)
    anchors = cut_lineage(_anchors(texts, size), "anchors")
    place = F.xxhash64("doc_id", "text_key", "place")
    again = cut_lineage(anchors.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"))
                        .where("a <> b").select("anchor", "n"), "again")
    marked, numbers = _list_by_text(_with_kept(anchors, again, ["anchor"]), F.col("place"), "at_doc", "at_text", "places")
    near = _beside_texts(texts, marked, numbers, F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("text_key") == F.col("at_text")), "inner")
    runs = cut_lineage(_runs_at(near, size), "runs")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "place", "end")
    kept = cut_lineage(runs.groupBy("digest_a", "digest_b").agg(F.min(rank).alias("kept"), F.max(rank).alias("other"), F.count(F.lit(1)).alias("n"))
                       .where("kept <> other or not (kept.doc_id <=> other.doc_id)").drop("other"), "kept")
    same_text = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_key") == F.col("kept.text_key"))
    return (_with_kept(runs, kept, ["digest_a", "digest_b"])
            .where(~(same_text & (F.col("place") == F.col("kept.place"))))
            .select("doc_id", "text_key", F.when(same_text, F.greatest("start", "kept.end")).otherwise(F.col("start")).alias("start"), "end"))


def _without_spans(text: pd.Series, kind: pd.Series, starts: pd.Series, ends: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """``starts`` and ``ends`` are the places that the units of ``text`` had in the original, or null."""
    texts, new_starts, new_ends = [], [], []
    for value, unit, firsts, lasts, cuts in zip(text, kind, starts, ends, spans, strict=True):
        merged: list[list[int]] = []
        for low, high in sorted((x["start"], x["end"]) for x in cuts):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        left, at = [], 0
        for low, high in merged:
            left.append((at, low))
            at = high
            while at < len(value) and value[at] in " \t" and (low == 0 or value[low - 1] in " \t\n"):
                at += 1
        left.append((at, len(value)))
        pieces, at = [], 0
        for first, last in [(0, len(value))] if firsts is None else zip(firsts, lasts, strict=True):
            size = last - first
            pieces += [(first + max(a, at) - at, first + min(b, at + size) - at) for a, b in left
                       if max(a, at) < min(b, at + size) or a <= at <= b and size == 0]
            at += size + len(_JOINT[unit])
        texts.append("".join(value[a:b] for a, b in left))
        new_starts.append([a for a, _ in pieces])
        new_ends.append([b for _, b in pieces])
    return pd.DataFrame({"text": texts, "starts": new_starts, "ends": new_ends})


def remove_repeated_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, offsets: bool = False,
                          passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` without the repeated units and passages, and without documents that have no text left by it.

    Only changed texts are put together anew. With ``offsets``, kept_starts and kept_ends give the places that kept
    parts had in the original text; they are null where nothing was removed.
    """
    id_, key, units, new = (free_name(docs, x) for x in ("gone_doc", "gone_text", "gone_units", "new_text"))
    own, old_starts, old_ends = (free_name(docs, x) for x in ("own_text", "old_starts", "old_ends"))
    gone, numbers = _list_by_text(repeated_units(docs, unit, min_words), F.col("unit"), id_, key, units)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key))
    joined = _beside_texts(docs, gone, numbers, same, "left")
    hit = F.col(units).isNotNull()
    cut = F.pandas_udf(_without_units, "struct<text: string, starts: array<long>, ends: array<long>>")
    joined = joined.withColumn(new, F.when(hit, cut(F.when(hit, F.col("text")).otherwise(""), F.lit(unit),
                                                    F.coalesce(units, F.array().cast("array<int>")))))
    joined = joined.where(~hit | (F.regexp_replace(F.col(f"{new}.text"), r"[\x20\x09-\x0D]", "") != "")).withColumn(own, F.xxhash64("text"))
    lined = with_text(joined, F.when(hit, F.col(f"{new}.text")).otherwise(F.col("text")))
    lined = cut_lineage(lined.select(*docs.columns, own, F.col(f"{new}.starts").alias(old_starts), F.col(f"{new}.ends").alias(old_ends)), "lined")

    texts = lined.select(F.col("doc_id").cast("long"), F.col(own).alias("text_key"), F.col("text").cast("string"))
    spans, numbers = _list_by_text(repeated_passages(texts, passage_words), F.struct("start", "end"), id_, key, units)
    joined = _beside_texts(lined, spans, numbers, lined["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left")
    cut = F.pandas_udf(_without_spans, "struct<text: string, starts: array<long>, ends: array<long>>")
    joined = joined.withColumn(new, F.when(hit, cut(F.when(hit, F.col("text")).otherwise(""), F.lit(unit), old_starts, old_ends,
                                                    F.coalesce(units, F.array().cast("array<struct<start: bigint, end: bigint>>")))))
    joined = joined.where(~hit | (F.regexp_replace(F.col(f"{new}.text"), _NO_WORD, "") != ""))
    out = with_text(joined, F.when(hit, F.col(f"{new}.text")).otherwise(F.col("text")))
    extra = [F.when(hit, F.col(f"{new}.{x}")).otherwise(F.col(y)).alias(f"kept_{x}") for x, y in (("starts", old_starts), ("ends", old_ends))]
    return out.select(*docs.columns, *(extra if offsets else []))
