"""WARC archives with revisit resolution.

Every page is one record.  Headers (page id, payload size, SHA-1) are shuffled by
payload digest; of equal payloads of at least `least` bytes the one with the
largest id is the response and the others become revisit records that refer to it.
Archives are written with fresh headers by Spark's text writer, each record ended
by the writer's line separator, so they land in whatever store the path names;
payloads of revisits are left out.  Files hold about FILE_BYTES each.  read() takes one record
at a time from a file's gzip stream, by its content length.  The full payload's length stands
in a header of our own, X-Payload-Length; a record's id is made from its page's id.

Only headers meet in a digest's group, pre-aggregated to one row per digest; the
payload goes through one shuffle by page.

Nulls: a null html is an empty payload; a null id is written without an id and is
the response for its payload only if no page with an id has it.  Rows repeated
with id and payload are judged alike.  Empty tables give an empty archive and no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime
from math import ceil
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored

#: Payloads below so many bytes are always written whole.
LEAST = 1000
#: Payload bytes in one archive file, about: pages are dealt to so many files that these hold as much on average; and records at most.
FILE_BYTES, RECORDS = 16_000_000, 2_000
_END = "\r\n\r\n"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, body binary"


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, bytes, record_type, refers_to): one row per different (page_id, digest)."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    heads = stored(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("digest"), F.length(body).cast("long").alias("bytes")).distinct(), "warc-heads")
    first = heads.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("original"))
    both = heads.join(first, "digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    return both.select("page_id", "digest", "bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def write(pages: DataFrame, path: str, date: str | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """Archives of all pages below path; date: that of the records, now if none is given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    plan = stored(resolve(pages, least), "warc-plan")
    every = pages.agg(F.coalesce(F.sum(F.octet_length(F.col("html").cast("string"))), F.lit(0))).first()[0]
    files = max(1, ceil(every / file_bytes))
    key = {"__id": F.coalesce("page_id", F.lit(0)), "__none": F.col("page_id").isNull(), "__digest": F.col("digest")}
    plan = plan.withColumns(key).drop("page_id", "digest")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    rows = rows.withColumns(key).repartition(files, *key).join(plan.hint("shuffle_hash"), list(key))  # the join keeps these partitions, one file each
    body = F.when(F.col("record_type") == "response", F.col("html")).otherwise(F.lit(""))
    uri = F.coalesce(F.regexp_replace(F.col("url"), r"[\r\n]", "%0A"), F.lit(""))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("record_type") == "revisit", line("WARC-Refers-To", record_id(F.col("refers_to")))).otherwise(F.lit("")),
        F.when(F.col("record_type") == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def records(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of an uncompressed archive, one at a time."""
    while first := archive.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {first[:40]!r} stands")
        head = {}
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError("an archive ends within a header")
            name, value = line.decode().rstrip("\r\n").split(": ", 1)
            head[name] = value
        body = archive.read(int(head["Content-Length"]))
        if archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head.get('WARC-Record-ID')} does not end where its length says")
        yield head, body


def _page(record_id: str | None) -> int | None:
    inner = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path; the digest of a response is that of the body read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("body", pa.binary())])
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                size = 0
                for head, body in records(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 20)):
                    whole = head["WARC-Type"] == "response"
                    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if whole and hashlib.sha1(body).hexdigest() != said:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                    rows.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], _page(head.get("WARC-Refers-To")), said, len(body) if whole else int(head["X-Payload-Length"]), body))
                    size += len(body)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Writes archives of all pages and reads them back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path, least=least)
    return read(spark, path)
