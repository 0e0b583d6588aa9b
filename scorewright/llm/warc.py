"""WARC archives with revisit records for repeated payloads.

Writing: payload digests (headers only, pre-aggregated by digest and salt) are
shuffled by digest to find the original of each payload; the result is joined
to the pages and every record gets fresh headers.  A payload is stored once.

That join is the one shuffle of payloads: headers alone cannot be told apart
where the pages lie without a table of all repeated digests in every task, and
such a table has no bound.  Payloads of revisits are dropped right behind it.

Records are gzipped one by one, as WARC readers expect, and gathered into
archives by their bytes: an archive ends with the record that takes it past
``archive_bytes``.  They are written through Spark's text writer, so any file
system that Spark reaches will do; the writer ends a file with one zero byte,
which is the padding that gzip allows.

Reading: an archive is unzipped member by member, and each record is cut by
its Content-Length, never by searching for separators.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.rows import named

#: Bytes of an archive, beyond which it has at most one record.
ARCHIVE_BYTES = 16 << 20
#: Parts that one payload's records are dealt over for joins.
SALTS = 64
CRLF = "\r\n"
#: What the writer puts behind an archive.
PAD = "\0"
LEVEL = 6
#: Bytes of an archive that are unzipped at once.
STEP = 1 << 14


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    # digits of base 32 as numbers are written, and as RFC 4648 writes them
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Columns ``id, url, payload, bytes, digest`` with ``refers_to,
    refers_to_url``: null for responses.

    Of the records with one payload of at least ``least_bytes`` bytes, that
    with the smallest id is the response and the others revisit it.  Rows that
    repeat the smallest id are responses too.  Null ids come last: they
    revisit a record that has an id, and are responses if there is none.
    Counts and minima are taken for each digest and salt first, so a payload
    that most rows share is one row per salt.
    """
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    heads = salted.where(F.col("bytes") >= least_bytes).groupBy("digest", "salt")
    known = F.when(F.col("id").isNotNull(), F.struct("id", "url"))
    heads = heads.agg(F.min(known).alias("known"), F.count("*").alias("n"))
    totals = heads.groupBy("digest").agg(F.min("known").alias("origin"), F.sum("n").alias("n")).where("n > 1 and origin is not null")
    origins = heads.select("digest", "salt").join(totals.select("digest", "origin"), "digest")
    found = salted.join(origins, ["digest", "salt"], "left")
    again = F.col("origin").isNotNull() & ~F.col("id").eqNullSafe(F.col("origin.id"))
    return found.select(
        "id", "url", "payload", "bytes", "digest",
        F.when(again, F.col("origin.id")).alias("refers_to"),
        F.when(again, F.col("origin.url")).alias("refers_to_url"),
    )


def _record_id(name: Column) -> Column:
    digits = F.md5(F.concat(F.lit("warc record "), name))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(*lines: tuple[str, Column]) -> Column:
    """Header lines; a line with a null value is left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit("")) for name, value in lines))


def records(resolved: DataFrame, date: str) -> DataFrame:
    """``head`` and ``body`` of each record, which ends with the block's CR LF CR LF.

    The block of a response is an HTTP response with the payload; that of a
    revisit has the same HTTP headers, so the full length of its payload, and
    no payload (``body`` is null).  Null urls are empty ones.
    """
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x20\x7f]", "%20")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    head = _header(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _record_id(F.concat(name, F.lit(" "), clean(F.col("url"))))),
        ("WARC-Target-URI", clean(F.col("url"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, _record_id(F.concat(F.col("refers_to").cast("string"), F.lit(" "), clean(F.col("refers_to_url")))))),
        ("WARC-Refers-To-Target-URI", F.when(revisit, clean(F.col("refers_to_url")))),
        ("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        ("X-Page-ID", F.col("id")),
        ("X-Refers-To-Page-ID", F.col("refers_to")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", length),
    )
    return resolved.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), head, F.lit(CRLF), http).alias("head"), F.when(~revisit, F.col("payload")).alias("body"))


def archives(made: DataFrame, archive_bytes: int) -> DataFrame:
    """``value``: one archive for each row, gzipped records one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

        for batch in batches:
            for head, body in zip(batch.column(0), batch.column(1), strict=True):
                record = b"".join((head.as_py(), body.as_py() or b"", b"\r\n\r\n"))
                held.append(gzip.compress(record, LEVEL, mtime=0))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    raw = made.select(F.col("head").cast("binary").alias("head"), F.col("body").cast("binary").alias("body"))
    return raw.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> None:
    """Write a record for each row as WARC files under ``path``.

    A null payload is empty, a null url is an empty one, other columns are not
    read.  An empty table writes no records.  Records are written where the
    join left them, so payloads are shuffled once; a task holds one archive.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(named(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        named(id_col).cast("long").alias("id"),
        named(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        base32_sha1(payload).alias("digest"),
    )
    made = archives(records(resolve(rows, least_bytes), date), archive_bytes)
    made.write.option("lineSep", PAD).option("maxRecordsPerFile", 1).text(path)


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time; zero bytes may follow the last."""
    view, at = memoryview(data), 0
    while at < len(view) and view[at] != ord(PAD):
        open_, parts, start = zlib.decompressobj(wbits=31), [], at
        while not open_.eof:  # in steps, as what is left over of a step is copied
            if at >= len(view):
                raise ValueError(f"the member at byte {start} is cut short")
            some = view[at : at + STEP]
            parts.append(open_.decompress(some))
            at += len(some)
        at -= len(open_.unused_data)
        yield b"".join(parts)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, data[start:stop]
        at = stop + 4


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives under ``path``, with payloads if asked for.

    Repeated rows are records of their own, archives without records give no
    rows.  A response's length and digest are taken from its payload and must agree
    with its headers; those of a revisit are what its headers declare.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for fields, block in (x for one in members(data) for x in parse_archive(one)):
                    http, _, body = block.partition(b"\r\n\r\n")
                    declared = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response":
                        seen = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if (len(body), seen) != (declared, digest):
                            raise ValueError(f"the payload of {fields['warc-record-id']} does not match its headers")
                    number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                    rows.append((number("x-page-id"), declared, digest, kind, number("x-refers-to-page-id"), fields["warc-target-uri"], body if payloads and kind == "response" else None))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, _READ)
