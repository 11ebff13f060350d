"""Quality rules over documents and over the lines that many documents of a host share.

Lines are normalised (A-Z in lower case, runs of white space as one space, digits as 0) and hashed. For
each host, the distinct documents of each line are counted. Lines in too many documents of their host are
removed, and a document that loses too much of its words is rejected as depleted.

A null or empty text has no words and no lines, and so fails the base rules. Rows with a null host are
one host of their own. A document counts once for a line however often it has it and however often
its row is repeated. Rows with the same doc_id are told apart by their text. Other columns are not looked at, and
``remove_frequent_lines`` keeps them.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import cut_lineage

from .frames import free_name, ship_package, with_text

#: A line is frequent in a host beyond this many documents and this share of the host's documents.
MIN_DOCUMENTS = 20
MAX_SHARE = 0.01
#: A document is depleted if more than this share of its words was in frequent lines.
MAX_LOST = 0.5
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Each line is joined with its host's frequent lines in one of so many slices.
SLICES = 16

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_CONTINUES = bytes(range(0x80, 0xC0))
_DIGITS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")

_STATS = ("doc_id long, text_key long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, line_keys array<long>, line_words array<long>")


def line_key(line: bytes) -> int | None:
    """The hash of a normalised line; None for a line without words."""
    words = line.translate(_DIGITS).split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def text_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        mark = np.zeros(len(words), dtype=bool)
        at = np.array([i for i, w in enumerate(windows) if w in often])
        for shift in range(3):
            mark[at + shift] = True
        repeated = int(mark.sum())
    return (len(words), len(b"".join(words).translate(None, _CONTINUES)), len(_SYMBOLS.findall(text)),
            len(lines) - len(set(lines)), repeated)


def _figures(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            raw = (text.as_py() or "").encode()
            lines: Counter[int] = Counter()
            for line in raw.split(b"\n"):
                key = line_key(line)
                if key is not None:
                    lines[key] += len(line.split())
            rows.append((*text_figures(raw), list(lines), list(lines.values())))
        figures = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), batch.column("host"),
             *(pa.array(x, pa.int64()) for x in figures[:5]), *(pa.array(x, pa.list_(pa.int64())) for x in figures[5:])],
            _STATS.replace(" long", "").replace(" string", "").replace(" array<long>", "").split(", "))


def document_figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Figures of each row of ``docs``, its hashed lines and the words in each, written as a table."""
    ship_package(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"),
                        F.col(host).cast("string").alias("host"), F.col("text").cast("string"))
    return cut_lineage(keyed.mapInArrow(_figures, _STATS), "figures")


def frequent_lines(figures: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line_key, documents) of the lines beyond both limits."""
    lines = figures.select("host", "doc_id", F.explode("line_keys").alias("line_key")).distinct()
    often = lines.groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > min_documents)
    hosts = figures.select("host", "doc_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
    hosts = hosts.withColumnRenamed("host", "of")
    return (often.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("documents") > max_share * F.col("of_host"))
            .select("host", "line_key", "documents"))


def frequent_lines_of_documents(figures: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(doc_id, text_key, lines, lost): hashes of the frequent lines of a document and the words in them.

    A very common line is spread over slices of the join by the document's hash.
    """
    often = cut_lineage(frequent_lines(figures, min_documents, max_share), "frequent")
    often = often.select(F.col("host").alias("of"), F.col("line_key").alias("key"),
                         F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    lines = figures.select("doc_id", "text_key", "host", F.explode(F.arrays_zip("line_keys", "line_words")).alias("line"))
    met = lines.join(often, (F.col("line.line_keys") == F.col("key")) & F.col("host").eqNullSafe(F.col("of"))
                     & (F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) == F.col("slice")))
    return (met.select("doc_id", "text_key", "key", F.col("line.line_words").alias("words")).distinct()
            .groupBy("doc_id", "text_key").agg(F.collect_list("key").alias("lines"), F.sum("words").alias("lost")))


def line_verdicts(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE,
                  max_lost: float = MAX_LOST) -> DataFrame:
    """Figures and verdict of every row: base_failed, n_removed_words, depleted and kept."""
    figures = document_figures(docs, host)
    met = frequent_lines_of_documents(figures, min_documents, max_share).select(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "lost")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    lost = F.coalesce("lost", F.lit(0))
    depleted = lost > max_lost * F.col("n_words")
    return (figures.join(met, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
                    lost.alias("n_removed_words"), depleted.alias("depleted")))


def _without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for value, keys in zip(text, gone, strict=True):
        dropped = set(keys)
        out.append("\n".join(line for line in value.split("\n") if line_key(line.encode()) not in dropped))
    return pd.Series(out)


def remove_frequent_lines(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE,
                          max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` without the frequent lines of each host and without depleted documents."""
    met = frequent_lines_of_documents(document_figures(docs, host), min_documents, max_share)
    id_, key, lines, lost = (free_name(docs, x) for x in ("met_doc", "met_text", "met_lines", "met_words"))
    met = met.toDF(id_, key, lines, lost)
    joined = docs.join(met, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key)), "left")
    hit = F.col(lost).isNotNull()
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    cut = F.pandas_udf(_without_lines, "string")
    text = F.when(hit, cut(F.coalesce("text", F.lit("")), F.coalesce(lines, F.array().cast("array<long>")))).otherwise(F.col("text"))
    return with_text(joined.where(~hit | (F.col(lost) <= max_lost * words)), text).select(*docs.columns)
