"""Queries that apply each operator to its whole tables, with the SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contamination
from .frames import read_table
from .jaccard_join import near_duplicate_groups
from .license_scan import scan_licenses
from .line_frequency import line_verdicts
from .lsh_forest import forest_groups
from .packing import pack_documents
from .prefix_trie import prefix_trie
from .quality import score_quality
from .token_counts import token_counts
from .toxicity import score_toxicity
from .unit_dedup import remove_repeated_units
from .warc import deduplicated_pages
from .whitening import whitened_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def _shingle_sql(size: int, percent: int) -> str:
    return rf"""
cut AS (SELECT doc_id, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END) AS s FROM cut),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM items a JOIN items b USING (x)
           WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
          WHERE 100 * k >= {percent} * (p.n + q.n - k)),
reach(node, seen) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT b, seen FROM reach JOIN links ON a = node)
"""


@_query("op4_ngram_jaccard_join", f"""
WITH RECURSIVE {_shingle_sql(5, 80)}
SELECT doc_id, n AS n_shingles, min(seen) AS component_id FROM sizes JOIN reach ON node = doc_id GROUP BY ALL""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents"))


DECONTAMINATION_SQL = r"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
            unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS x
          FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM spans),
runs AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM words, sizes WHERE len(w) >= k),
texts AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM runs),
found AS (SELECT doc_id, item_id, i, k FROM texts JOIN spans USING (k, x)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
"""


@_query("op2_decontamination", f"""
WITH {DECONTAMINATION_SQL}
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("item_ids")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


LINES_SQL = r"""
base AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
          FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM base)),
real AS (SELECT doc_id, source, line, len(lw) AS n, translate(array_to_string(lw, ' '),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm FROM lines WHERE len(lw) > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM real GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source),
often AS (SELECT source, norm FROM real JOIN hosts USING (source) GROUP BY source, norm, docs
          HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.01 * docs),
gone AS (SELECT doc_id, sum(n) AS lost FROM real SEMI JOIN often USING (source, norm) GROUP BY doc_id),
places AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
             unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS x FROM base WHERE len(w) > 2)),
twice AS (SELECT doc_id, x FROM places GROUP BY doc_id, x HAVING count(*) > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
         FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM places SEMI JOIN twice USING (doc_id, x)) GROUP BY doc_id),
figures AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
              len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
              coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
              CAST(coalesce(lost, 0) AS BIGINT) AS n_removed_words
            FROM base LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN gone USING (doc_id))
"""


@_query("op1_line_frequency", f"""
WITH {LINES_SQL}
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept,
       n_removed_words > 0.5 * n_words AS depleted
FROM figures""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(read_table(spark, sf_dir, "documents"))


@_query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


@_query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


WARC_SQL = r"""
raw AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM raw),
coded AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
              CAST((('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest
          FROM hashed)
"""


@_query("op3_warc_revisits", f"""
WITH {WARC_SQL}
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY payload_digest) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER (PARTITION BY payload_digest) THEN max(page_id) OVER (PARTITION BY payload_digest) END AS refers_to
FROM coded""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_pages(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


UNITS_SQL = r"""
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS unit, unnest(l) AS line
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
placed AS (SELECT doc_id, unit, line, CAST(coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines),
words AS (SELECT doc_id, unit, start, start + len(line) AS "end", regexp_extract_all(
            translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM placed),
units AS (SELECT *, array_to_string(w, ' ') AS norm FROM words WHERE len(w) >= 10),
ranked AS (SELECT *, row_number() OVER p AS r, first_value(doc_id) OVER p AS kept_doc_id, first_value(unit) OVER p AS kept_unit,
             first_value(start) OVER p AS kept_start FROM units WINDOW p AS (PARTITION BY norm ORDER BY doc_id, unit))
"""


#: The units alone; the passages that follow them have no SQL and are tested against a plain rule.
REPEATED_UNITS_SQL = f"""
WITH {UNITS_SQL}
SELECT doc_id, CAST(unit AS INT) AS unit, start, "end", kept_doc_id, CAST(kept_unit AS INT) AS kept_unit, kept_start FROM ranked WHERE r > 1"""


@_query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that keeps text, with what is left of it and the places that this had in the original."""
    left = remove_repeated_units(read_table(spark, sf_dir, "documents"), offsets=True)
    return left.select("doc_id", "text", F.col("kept_starts").isNotNull().alias("changed"), "kept_starts", "kept_ends")


@_query("op5_license_alignment")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


@_query("op6_toxicity_fm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_query("op8_quality_cnn")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


TRIE_SQL = r"""
turns AS (SELECT conv_id, idx, md5(key) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(key)) AS idx FROM (
              SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS key
              FROM conversations WHERE conv_id IS NOT NULL))),
convs AS (SELECT conv_id, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
            string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
            lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END))) % 4 AS h FROM turns GROUP BY conv_id),
opening AS (SELECT c.conv_id, idx AS depth, key, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND idx <= h),
lent AS (SELECT conv_id, count(*) AS m FROM opening GROUP BY conv_id),
rebuilt AS (SELECT * FROM opening UNION ALL SELECT conv_id, idx - h + coalesce(m, 0), key, words
            FROM turns JOIN convs USING (conv_id) LEFT JOIN lent USING (conv_id) WHERE idx > h),
paths AS MATERIALIZED (SELECT conv_id, depth, words, md5(array_to_string(list(key) OVER (PARTITION BY conv_id ORDER BY depth), ',')) AS path FROM rebuilt
          UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY path, depth),
parents AS (SELECT n.path, p.path AS above, u.conv_id AS parent_conv_id FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
            JOIN nodes u ON u.path = p.path),
kids AS (SELECT above AS path, count(*) AS n_children FROM parents GROUP BY above),
sums AS (SELECT p.path, count(*) FILTER (WHERE kids.path IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * n.words) AS BIGINT) AS saved_tokens
         FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids ON kids.path = n.path GROUP BY p.path),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM paths JOIN lengths USING (conv_id, depth) GROUP BY path)
"""


@_query("op13_prefix_trie", f"""
WITH {TRIE_SQL}
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes LEFT JOIN parents USING (path) LEFT JOIN kids USING (path) JOIN sums USING (path) LEFT JOIN ends USING (path)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


@_query("op12_exact_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(read_table(spark, sf_dir, "embeddings"))


@_query("op11_lsh_forest", f"""
WITH RECURSIVE {_shingle_sql(3, 85)}
SELECT doc_id, n AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept FROM sizes JOIN reach ON node = doc_id GROUP BY doc_id, n""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_groups(read_table(spark, sf_dir, "documents"))
