"""Operator 6, WARC: write deduplicated archives, read them back and resolve their revisits.

Only headers (id, URL, digest, length) are shuffled by payload digest, to find for each digest the
record with the smallest id: it becomes the response, the others revisit it. Payloads are shuffled
once, by (digest, id), to pick the responses, so a payload shared by many pages does not land in one task. They are dealt to as many
tasks as there are ``file_bytes`` of payloads, so a file has about that many bytes before compression, plus a record; ``records_per_file``
bounds its records. Records are written with Spark's text writer, whose line separator is the empty lines that end a WARC record; its
commit protocol makes retried tasks harmless. Archives are read whole by file, decompressed and cut by Content-Length as a stream.

Defined cases: a null payload is empty; payloads under ``min_bytes`` are always responses. Repeated
rows with the smallest id of a digest are all responses, and revisits refer to one of them; each record has an id of its own.
A payload must be under 1 GB, and ``file_bytes`` is best well under that. A null id is never the smallest unless all
ids of the digest are null; then all are responses. A null URL leaves out WARC-Target-URI; white space and
control characters in URLs are percent-encoded. Empty tables give an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.llm.shared import Scratch, partitions

END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_id string, refers_to_url string"


def base32(digest: Column) -> Column:
    """A hexadecimal SHA-1 in upper-case base32: each character is five of the 160 bits, taken from two hex digits."""
    two = lambda i: F.conv(F.substring(digest, F.floor(i * 5 / 4).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
    five = lambda i: F.call_function("shiftright", two(i), 3 - i * 5 % 4).bitwiseAND(F.lit(31))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit(BASE32), five(i) + 1, F.lit(1))), "")


def _record_id(page: Column, digest: Column, copy: Column) -> Column:
    """An id from page and digest; ``copy`` counts rows that have both in common, from 1."""
    h = F.md5(F.concat_ws("|", page.cast("string"), digest, F.when(copy > 1, copy.cast("string"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _safe(url: Column) -> Column:
    for found, put in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), ("[\\x00-\\x20\\x7f]", "%20")):
        url = F.regexp_replace(url, found, put)
    return url


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _record(kind: str, page: Column, url: Column, digest: Column, copy: Column, http: Column, block: Column, date: str, more: list[tuple[str, Column]]) -> Column:
    lines = [
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", _record_id(page, digest, copy)),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _safe(url)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        *more,
        ("X-Page-Id", page),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(http) + F.octet_length(block)),
    ]
    return F.concat(F.lit("WARC/1.1\r\n"), *(_line(k, v) for k, v in lines), F.lit("\r\n"), http, block)


def write_archives(
    pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0, records_per_file: int = 10_000, file_bytes: int = 64 << 20, date: str | None = None
) -> None:
    """Write one record a row below ``path``: a response for the first of each payload, revisits for the others."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    scratch = Scratch(pages.sparkSession, "warc")
    named = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    headers = scratch.write(named.select("page", "url", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), "headers")
    large = headers.where(F.col("bytes") >= min_bytes)
    first = scratch.write(large.groupBy(F.col("sha1").alias("of")).agg(F.min(F.struct(F.col("page").isNull().alias("none"), "page", "url")).alias("least")).select("of", F.col("least.page").alias("first"), F.col("least.url").alias("first_url")), "first")
    total = headers.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(partitions(pages.sparkSession), -(-total // file_bytes))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    # By one partitioning, with a key that is never null: the join with what is chosen, and the count of rows that repeat a response.
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    known = named.withColumn("sha1", F.sha1("payload")).withColumn("name", name("page")).repartition(tasks, "sha1", "name")
    copy = F.row_number().over(W.Window.partitionBy("sha1", "name").orderBy("url"))
    # Not a semi-join: Spark would move that below the partitioning and shuffle payloads twice. There is one row a digest in ``first``.
    chosen = known.where(F.octet_length("payload") >= min_bytes).join(first.select("of", name("first").alias("of_name")), (F.col("sha1") == F.col("of")) & (F.col("name") == F.col("of_name")))
    chosen = chosen.select(known.columns)
    if min_bytes > 0:
        chosen = chosen.unionAll(known.where(F.octet_length("payload") < min_bytes))
    chosen = chosen.withColumn("copy", copy).withColumn("digest", base32(F.col("sha1")))
    responses = chosen.select(_record("response", F.col("page"), F.col("url"), F.col("digest"), F.col("copy"), http, F.col("payload"), date, []).alias("value"))
    repeats = large.join(first, F.col("sha1") == F.col("of")).where(~F.col("page").eqNullSafe(F.col("first"))).withColumn("name", name("page")).withColumn("copy", copy).withColumn("digest", base32(F.col("sha1")))
    refers = [
        ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", _record_id(F.col("first"), F.col("digest"), F.lit(1))),
        ("WARC-Refers-To-Target-URI", _safe(F.col("first_url"))),
        ("WARC-Refers-To-Date", F.lit(date)),
    ]
    headed = F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{END}")
    revisits = repeats.select(_record("revisit", F.col("page"), F.col("url"), F.col("digest"), F.col("copy"), headed, F.lit(""), date, refers).alias("value"))
    responses.unionAll(revisits).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _pieces(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, at most ``size`` at a time, decompressed member by member if it is gzip."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), size):
            yield content[at : at + size]
        return
    rest = memoryview(content)
    while rest:
        member, at = zlib.decompressobj(31), 0
        while not member.eof:
            # What a call leaves undone for want of room comes first in the next one.
            data = member.unconsumed_tail
            if not data:
                data, at = rest[at : at + size], at + size
                if not data:
                    raise ValueError("a gzip member is cut off")
            yield member.decompress(data, size)
        rest = rest[min(at, len(rest)) - len(member.unused_data) :]


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a stream; bytes are copied once when they come and once when they go."""
    held, at = bytearray(), 0

    def need(n: int) -> bool:
        """Hold n bytes from the place read up to, if there are as many. What has been read goes when something is added."""
        nonlocal at
        while len(held) - at < n:
            if (piece := next(pieces, None)) is None:
                return False
            del held[:at]
            at = 0
            held.extend(piece)
        return True

    while True:
        looked = 0
        while (end := held.find(b"\r\n\r\n", at + looked)) < 0:
            looked = max(0, len(held) - at - 3)
            if not need(len(held) - at + 1):
                if held[at:].strip():
                    raise ValueError("a record header is cut off")
                return
        version, *lines = bytes(held[at:end]).split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines)}
        at, length = end + 4, int(fields["content-length"])
        if not need(length + 4):
            raise ValueError("a record is cut off")
        yield fields, bytes(held[at : at + length])
        at += length + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``; a response's payload is measured, digested and held against its header."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["record_id", "record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to_id", "refers_to_url"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                out = []
                for head, block in parse(_pieces(content.as_py())):
                    digest, size = head.get("warc-payload-digest", "").removeprefix("sha1:"), None
                    if head["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest and found != digest:
                            raise ValueError(f"{head['warc-record-id']}: the payload's digest is {found}, not {digest}")
                        digest = found
                    page = head.get("x-page-id")
                    out.append((head["warc-record-id"], head["warc-type"], int(page) if page else None, head.get("warc-target-uri"), digest, size, head.get("warc-refers-to"), head.get("warc-refers-to-target-uri")))
                columns = list(zip(*out, strict=True)) or [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=fields)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(rows, RECORDS)


def resolve(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Responses as they are, and revisits joined by digest to the response with the smallest page id."""
    records = scratch.write(records, "records")
    responses = records.where("record_type = 'response'")
    known = scratch.write(responses.groupBy(F.col("payload_digest").alias("of")).agg(F.min("page_id").alias("first"), F.min("payload_bytes").alias("bytes")), "known")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    resolved = (
        records.where("record_type = 'revisit'")
        .join(known, F.col("payload_digest") == F.col("of"), "left")
        .select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first").alias("refers_to"))
    )
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionAll(resolved)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive, read back with its revisits resolved."""
    scratch = Scratch(spark, "archive")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("warc"), "page_id", "url", "html")
    return resolve(read_archives(spark, scratch.path("warc")), scratch)


ORACLE = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, ((5 * i) // 4 + 1)::INT, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31), 1)), '') AS payload_digest
  FROM hashed
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM firsts
"""
