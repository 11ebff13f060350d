"""WARC archives of pages, and their revisit records.

Pages are written as response records. Reading the archives back, only headers are shuffled: by payload
digest, to find the original of each group of equal payloads. Every other record of a group is joined to its
original and becomes a revisit record; the records are written to new archives with fresh headers.

The original is the record with the largest page_id; of equal page_ids, the last by its place in the archives.
A null html is an empty payload; payloads shorter than ``min_bytes`` are never revisits. A null page_id is the
smallest, and stays null. A null url has no WARC-Target-URI; control characters and blanks in one are
written as %20. Other columns are not looked at.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import cut_lineage, scratch_path

from .frames import ship_package

#: Bytes of one archive before compression, about.
ARCHIVE_BYTES = 16 << 20
#: Revisit records that may be broadcast when the new archives are written, about 100 bytes each.
BROADCAST_REVISITS = 100_000

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"
_FIELDS = {"file": pa.string(), "place": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(),
           "record_id": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.string()}
_SCHEMA = ("file string, place long, page_id long, url string, record_type string, record_id string, payload_digest string, "
           "payload_bytes long, refers_to long, payload string")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32, without prefix: each five hexadecimal digits are four letters."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def write_archives(records: DataFrame, path: str, per_file: int) -> None:
    """Write records (page_id, url, record_type, payload_digest, payload_bytes, refers_to, refers_id, payload) as archives.

    A record's text ends with its payload; the writer's line separator is the end mark of a record.
    """
    name = F.md5(F.concat_ws("|", F.uuid(), "page_id", "payload_digest"))
    record_id = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    record = F.concat(
        F.lit(f"WARC/1.1{_END}"), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", record_id),
        _header("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), _header("WARC-Refers-To", F.col("refers_id")),
        _header("WARC-Profile", F.when(F.col("record_type") == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("X-Page-Id", F.col("page_id")), _header("X-Refers-To-Page-Id", F.col("refers_to")),
        _header("X-Payload-Length", F.col("payload_bytes")), F.lit(f"Content-Type: text/html; charset=UTF-8{_END}"),
        _header("Content-Length", F.octet_length(body)), F.lit(_END), body)
    (records.select(record.alias("value")).write.option("lineSep", _END * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def parse_archive(raw: bytes) -> Iterator[dict]:
    """The records of one archive, by the lengths their headers give."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in raw[at:stop].decode().split(_END)[1:])
        body = raw[stop + 4:stop + 4 + int(head["Content-Length"])]
        number = {x: int(head[x]) if x in head else None for x in ("X-Page-Id", "X-Refers-To-Page-Id", "X-Payload-Length")}
        yield {"place": at, "page_id": number["X-Page-Id"], "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
               "record_id": head["WARC-Record-ID"], "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
               "payload_bytes": number["X-Payload-Length"], "refers_to": number["X-Refers-To-Page-Id"], "payload": body.decode()}
        at = stop + 4 + len(body) + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, with its file and place there."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                some, held = [], 0
                for record in parse_archive(gzip.decompress(content.as_py())):
                    held += len(record["payload"])
                    some.append(record | {"file": file.as_py()} | ({} if payloads else {"payload": None}))
                    if held > 1 << 22:
                        yield _batch(some)
                        some, held = [], 0
                if some:
                    yield _batch(some)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(run, _SCHEMA)


def _batch(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], t) for k, t in _FIELDS.items()], list(_FIELDS))


def _per_file(rows: int, size: int, archive_bytes: int) -> int:
    return max(1, archive_bytes * max(rows, 1) // max(size, 1))


def write_pages(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One response record for each row of ``pages`` (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(payload)), F.lit(0))).first()
    write_archives(pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.lit("response").alias("record_type"), base32_sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_id"), payload.alias("payload")), path, _per_file(rows, size, archive_bytes))


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives below ``source`` anew below ``target``, with revisit records for repeated payloads."""
    heads = cut_lineage(read_archives(spark, source, payloads=False).drop("payload", "refers_to"), "heads")
    groups = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.max(F.struct("page_id", "file", "place", "record_id")).alias("original"), F.count(F.lit(1)).alias("records"))
    originals = cut_lineage(groups.where("records > 1").select("payload_digest", "payload_bytes", "original"), "originals")
    revisits = cut_lineage(
        heads.join(originals, ["payload_digest", "payload_bytes"])
        .where("file <> original.file or place <> original.place")
        .selectExpr("file", "place", "original.page_id refers_to", "original.record_id refers_id"), "revisits")
    rows, size = heads.agg(F.count(F.lit(1)), F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    records = (read_archives(spark, source).drop("refers_to").join(revisits, ["file", "place"], "left")
               .withColumn("record_type", F.when(F.col("refers_id").isNull(), "response").otherwise("revisit")))
    write_archives(records, target, _per_file(rows, size, archive_bytes))


def deduplicated_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, resolve revisits, and read every record of the new archives."""
    spark = pages.sparkSession
    first, second = scratch_path(spark, "archives"), scratch_path(spark, "deduplicated")
    write_pages(pages, first)
    resolve_revisits(spark, first, second, min_bytes)
    return read_archives(spark, second)
