"""Deduplicated web archives: revisits are found by payload digest and refer to their response.

Headers alone are shuffled by digest; a payload moves once, by its page, to meet the
decision on it. Archives are written by Spark's text writer, one
record a row and the record's own end as the separator, so that any store Spark can
write to will do, and a lost executor's file is written again by the usual commit.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import scratch_path, table, written

_END = "\r\n\r\n"
#: Pages tell no headers of their own; a response has these.
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def base32_sha1(payload) -> F.Column:
    """Upper-case base32 of a column's SHA-1, from built-in functions: 5 hex digits are 4 letters."""
    digits = F.sha1(payload.cast("binary"))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        value = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substr(letters, F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.col("url"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def revisits(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Of each digest that several pages share, every page but the smallest: page_id, digest, refers_to, first_url.

    The smallest page_id of a digest is aggregated before the shuffle, so a digest of a
    third of all rows costs no more than any other; the join that follows takes only
    digests seen twice and leaves a hot one to the skew join.
    """
    first = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.max("bytes").alias("size"), F.min_by("url", F.struct("page_id", "url")).alias("first_url"))
    shared = first.where((F.col("refers_to") < F.col("last")) & (F.col("size") >= least_bytes)).select("digest", "refers_to", "first_url")
    return heads.join(shared, "digest").where(F.col("page_id") > F.col("refers_to")).select("page_id", "digest", "refers_to", "first_url").distinct()


def decisions(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """What a record must know beyond its own page: page_id, digest, refers_to, first_url, first_copied, copied.

    Rows are the revisits, and the pages that come with the same payload more than once
    (``copied``); ``first_copied`` says so of a revisit's response. Other pages have none.
    """
    copies = heads.where("page_id IS NOT NULL").groupBy("page_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("page_id", "digest", F.lit(True).alias("copied"))
    firsts = copies.select(F.col("page_id").alias("refers_to"), "digest", F.col("copied").alias("first_copied"))
    return revisits(heads, least_bytes).join(firsts, ["refers_to", "digest"], "left").join(copies, ["page_id", "digest"], "full_outer")


def _urn(writing: str, page_id, url, digest) -> F.Column:
    """A response's name: a UUID made of this writing, its page, target and payload, so that a revisit can name it."""
    x = F.md5(F.concat_ws("|", F.lit(writing), page_id.cast("string"), digest, F.coalesce(url, F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(x, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str | None = None, most_records: int = 5_000, most_bytes: int = 1 << 30) -> None:
    """A WARC record for each page: a response (an HTTP message) with its payload, or a revisit without one.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the
    smallest page_id is the response. Null html is an empty payload. Rows that repeat a
    response's page_id and payload are responses too; a null page_id is a response.
    Payloads are shuffled once at most, to meet their decision; a partition is a file, or
    several of at most ``most_records`` records each, and of at most ``most_bytes`` bytes
    of payload before compression, so that each can be read as one row. Pages longer than
    an even share of that go to files of their own, with so many fewer records; only then
    are pages read once more. One payload above ``most_bytes`` is a file by itself.
    Headers are fresh: record ids that no other record or writing has, ``date`` (by default
    the time of writing) and, in revisits, the target and date of the response, and its id
    unless its page_id comes with that payload more than once. No rows give no records;
    other columns are ignored.
    """
    date = date or f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"
    writing = uuid.uuid4().hex
    # read again below, and cheap beside the pages it saves reading again
    heads = written(headers(pages), "warc-headers")
    again = written(decisions(heads, least_bytes), "warc-decisions")
    payload = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("digest"))
    joined = own.join(again, ["page_id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", "")
    fresh = F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    named = F.col("page_id").isNotNull() & ~revisit & F.col("copied").isNull()
    http = F.concat(F.lit(f"{_HTTP}\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.concat(http, "payload"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), F.when(named, _urn(writing, F.col("page_id"), F.col("url"), F.col("digest"))).otherwise(fresh)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit & F.col("first_copied").isNull(), F.concat(F.lit("WARC-Refers-To: "), _urn(writing, F.col("refers_to"), F.col("first_url"), F.col("digest")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), clean(F.col("first_url")))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-Id: "), F.col("refers_to").cast("string"))),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), body)

    def save(rows: DataFrame, most: int, mode: str) -> None:
        rows.select(record.alias("value")).write.mode(mode).option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)

    usual, longest = max(1, most_bytes // most_records), heads.agg(F.max("bytes")).first()[0] or 0
    if longest <= usual:
        return save(joined, most_records, "error")
    save(joined.where(F.octet_length("payload") <= usual), most_records, "error")
    save(joined.where(F.octet_length("payload") > usual), max(1, most_bytes // longest), "append")


def records(chunks):
    """Header fields and block (of a response, an HTTP message) of each record of a gzip'd archive, from chunks of its bytes.

    Records are told apart by their Content-Length alone, so a payload may hold anything.
    """
    gz, held = zlib.decompressobj(wbits=47), bytearray()
    source = iter(chunks)

    def more() -> bool:
        nonlocal gz
        for chunk in source:
            while chunk:
                held.extend(gz.decompress(chunk))
                chunk = gz.unused_data
                if gz.eof:
                    gz = zlib.decompressobj(wbits=47)
            return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends within a header")
                return
        first, *fields = held[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        found = dict(f.split(": ", 1) if ": " in f else (f.rstrip(":"), "") for f in fields)
        size = int(found["Content-Length"])
        while len(held) < end + 8 + size:
            if not more():
                raise ValueError("an archive ends within a record")
        yield found, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every record.

    No archives give no rows; a null url comes back empty. A response's length and digest come from its payload, and must agree with its header.
    """

    def parse(batches):
        import pyarrow as pa

        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)))
        number = lambda s: None if s is None else int(s)
        for batch in batches:
            for content in batch.column("content"):
                view = memoryview(content.as_buffer())
                rows, held = [], 0
                for f, block in records(view[i : i + 65536] for i in range(0, len(view), 65536)):
                    payload = block[block.find(b"\r\n\r\n") + 4 :] if block else block
                    kind, digest, size = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"the payload of {f['WARC-Record-ID']} is not what its header says")
                    rows.append((number(f.get("X-Page-Id")), f["WARC-Target-URI"], payload if kind == "response" else None, size, digest, kind, number(f.get("X-Refers-To-Page-Id"))))
                    held += len(payload)
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x FROM p),
g AS (SELECT i, 5 * i + 1 AS spot FROM range(8) t(i)),
b AS (
  SELECT d.page_id, any_value(strlen(d.h)) AS payload_bytes,
    string_agg(
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, spot, 5))::BIGINT >> 15) & 31) + 1)::BIGINT, 1) ||
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, spot, 5))::BIGINT >> 10) & 31) + 1)::BIGINT, 1) ||
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, spot, 5))::BIGINT >> 5) & 31) + 1)::BIGINT, 1) ||
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, spot, 5))::BIGINT & 31) + 1)::BIGINT, 1), '' ORDER BY i) AS payload_digest
  FROM d, g GROUP BY d.page_id),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
