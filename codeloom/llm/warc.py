"""WARC archives with revisit records for repeated payloads.

Only headers (id, digest, length) move by payload digest: they are summed to
one row for each repeated digest and joined with it again, a digest that fills
much of the table dealt to many tasks. What comes out, the revisits, meets the
payloads by id and digest, so payloads move once, and evenly, to about
``file_bytes`` a task. A task writes one file, so files hold about that much
before compression whatever single pages are like, and one page more at most
where it is larger. Archives are written by Spark's text writer whose line
separator is the blank lines that end a record, so each part file is an archive
by itself, gzipped as a whole (the writer can't gzip record by record).

Defined results: null html is an empty payload; null ids count as smaller than
any id and read back as null; if the largest id of a group occurs in several
rows, each of those rows is a response; records are named by id and digest;
other columns are ignored; control characters in a url become spaces.
"""

from __future__ import annotations

import gzip
import hashlib
import math
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, salted_join, work_dir

MIN_BYTES = 1000
FILE_BYTES = 32 << 20
HEADER_BYTES = 700
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def with_payload(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit(""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    return pages.select("page_id", name.alias("_name"), "url", body.alias("_body"), F.octet_length(body).cast("long").alias("_n"), F.sha1(body.cast("binary")).alias("_digest"))


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(_name, _digest, _refers): the records that repeat the payload of a larger id, and that id."""
    heads = with_payload(pages).where(F.col("_n") >= min_bytes).select("page_id", "_name", "_digest")
    groups = heads.groupBy("_digest").agg(F.max("page_id").alias("_refers"), F.count("*").alias("_count")).where("_count > 1").drop("_count")
    met = salted_join(heads, groups, "_digest", "_name", "inner")
    return met.where(~F.col("page_id").eqNullSafe(F.col("_refers"))).select("_name", "_digest", "_refers").distinct()


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES, parts: int | None = None) -> DataFrame:
    """``pages`` with payload columns and ``_refers`` (the id of the response that a revisit refers to, null for a response)."""
    key = ["_name", "_digest"]
    # headers come along in the payloads' own shuffle; a join would deal payloads anew for its own number of tasks
    both = with_payload(pages).unionByName(revisits(pages, min_bytes), allowMissingColumns=True)
    both = both if parts is None else both.repartition(parts, *key)
    return both.withColumn("_refers", F.max("_refers").over(Window.partitionBy(*key))).where(F.col("_body").isNotNull())


def _line(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _uri(name) -> F.Column:
    return F.concat(F.lit("<urn:page:"), name, F.lit(":"), F.col("_digest"), F.lit(">"))


def records(resolved: DataFrame, date: str) -> DataFrame:
    """One column ``value``: each record without the blank lines that end it."""
    is_revisit = F.col("_refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_n").cast("string"), F.lit(END))
    length = F.length(http) + F.when(is_revisit, 0).otherwise(F.col("_n"))
    url = F.regexp_replace("url", r"[\x00-\x1F\x7F]", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uri(F.col("_name"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(is_revisit, F.concat(_line("WARC-Refers-To", _uri(F.col("_refers").cast("string"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return resolved.select(F.concat(head, http, F.when(is_revisit, "").otherwise(F.col("_body"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, date: str | None = None) -> None:
    """Write ``pages`` (page_id, url, html) as archives of about ``file_bytes`` before compression below ``path``; ``date`` (now, if not given) goes to all headers."""
    total = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + HEADER_BYTES)).first()[0] or 0
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    resolved = resolve_revisits(pages, min_bytes, max(1, math.ceil(total / file_bytes)))
    records(resolved, date).write.option("lineSep", END).option("compression", "gzip").text(path)


def _number(uri: str) -> int | None:
    text = uri.removeprefix("<urn:page:").removesuffix(">").rpartition(":")[0]
    return None if text == "null" else int(text)


def parse_archive(raw: bytes):
    """(page id, type, payload digest, payload length, refers-to id) of each record; payloads are checked against their digests."""
    at = 0
    while at < len(raw):
        split = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:split].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        begin, size = split + 4, int(head["Content-Length"])
        http = raw.index(b"\r\n\r\n", begin) + 4
        length = int(raw[begin:http].rsplit(b"Content-Length: ", 1)[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (http + length != begin + size or hashlib.sha1(memoryview(raw)[http : begin + size]).hexdigest() != digest):
            raise ValueError(f"payload of the record at byte {at} differs from its digest")
        refers = head.get("WARC-Refers-To")
        yield _number(head["WARC-Record-ID"]), head["WARC-Type"], digest, length, None if refers is None else _number(refers)
        at = begin + size
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} isn't ended by blank lines")
        at += 4


def _parse(batches):
    for batch in batches:
        for content in batch["content"]:
            rows = list(parse_archive(gzip.decompress(content.as_buffer())))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to"])


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_parse, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path)


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
        CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN NULL ELSE keeper END AS refers_to
FROM h
"""
