"""WARC archives: write request, response (or revisit) and metadata records, read them back, assemble captures.

Archives are text files of Spark's own writer whose line end is the CRLF CRLF that closes a WARC record, so they go
wherever Spark can write. Reading takes each file whole, cuts records by their Content-Length and joins them through
WARC-Concurrent-To into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import attach, stage, table
from spindlescope.session import ensure_checkpoint_dir

#: Records of a file at most; with the split size of the scan this bounds what one reader holds.
RECORDS_PER_FILE = 3000
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT_BYTES = 0
EPOCH = "2024-01-01T00:00:00Z"
RECORD = ("record_id string, kind string, concurrent_to string, uri string, content_type string, refers_to string, "
          "payload_digest string, payload_bytes long, page_id long, body binary")

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 160 bits are 32 letters of five bits."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * i, 5), 16, 2), 20, "0") for i in range(8)])
    letters = [F.substring(F.lit(_B32), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)]
    return F.concat(*letters)


def _header(kind: str, record_id: Column, *lines: Column) -> Column:
    parts = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {EPOCH}\r\nWARC-Record-ID: <"), record_id, F.lit(">")]
    for line in lines:
        parts += [F.lit("\r\n"), line]
    return F.concat(*parts)


def _record(head: Column, body: Column) -> Column:
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def _field(name: str, value: Column) -> Column:
    """One header line; line ends in a value become blanks."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " "))


def write_warc(pages: DataFrame, folder: str) -> None:
    """Write three records per row of ``pages`` (page_id, url, html) to gzip files in ``folder``.

    Of equal payloads the one with the smallest page_id (the first of repeated ids by url) is a response, the others
    are revisits of it that carry no payload. A null html is an empty payload, a null url an empty target; rows
    without a page_id are left out. Other columns are left behind.
    """
    rows = pages.where("page_id IS NOT NULL").select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    first = keyed.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    # only payloads that occur again need their first page; the others answer for themselves
    again = stage(first.where((F.col("copies") > 1) & (F.col("bytes") >= LEAST_REVISIT_BYTES)).select("digest", "first"))
    named = attach(stage(keyed.select("page_id", "digest")), again, "digest", "inner").where("first < page_id").distinct()
    marked = keyed.join(named, ["page_id", "digest"], "left")
    rid = lambda kind, page: F.concat(F.lit(f"urn:capture:{kind}:"), page.cast("string"))
    page, revisit = F.col("page_id"), F.col("first").isNotNull()
    uri, main = _field("WARC-Target-URI", F.col("url")), rid("response", F.col("page_id"))
    seen = [F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.concat(F.lit("X-Payload-Bytes: "), F.col("bytes").cast("string"))]
    response = _record(_header("response", main, uri, F.lit("Content-Type: text/html; charset=utf-8"), *seen), F.col("html"))
    repeat = _record(_header("revisit", main, uri, F.lit("Content-Type: text/html; charset=utf-8"),
                             F.concat(F.lit("WARC-Refers-To: <"), rid("response", F.col("first")), F.lit(">")), *seen), F.lit(""))
    link = F.concat(F.lit("WARC-Concurrent-To: <"), main, F.lit(">"))
    request = _record(_header("request", rid("request", page), link, uri, F.lit("Content-Type: application/http")),
                      F.concat(F.lit("GET "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit(" HTTP/1.1\r\n")))
    metadata = _record(_header("metadata", rid("metadata", page), link, uri, F.lit("Content-Type: application/warc-fields")),
                       F.concat(F.lit("page-id: "), page.cast("string"), F.lit("\r\n")))
    out = marked.select(F.explode(F.array(F.when(revisit, repeat).otherwise(response), request, metadata)).alias("value"))
    (out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


def parse_warc(raw: bytes):
    """Records of one archive as (headers, body); lengths rule, so a body may hold anything."""
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.index(b"\r\n\r\n", at)
        headers = {}
        for line in raw[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        start = end + 4
        at = start + int(headers["content-length"])
        yield headers, raw[start:at]


def _records(with_payload: bool):
    def read(frames):
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for h, body in parse_warc(zlib.decompress(content, 31)):
                    kind, strip = h["warc-type"], lambda k: h.get(k, "").strip("<>") or None  # noqa: B023
                    digest, size, page = h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("x-payload-bytes"), None
                    if kind == "response":  # taken from the bytes themselves, not from what the writer said
                        digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
                    if kind == "metadata":
                        page = int(body.split(b":")[1])
                    rows.append((strip("warc-record-id"), kind, strip("warc-concurrent-to"), h.get("warc-target-uri"),
                                 h.get("content-type"), strip("warc-refers-to"), digest, None if size is None else int(size), page,
                                 body if with_payload or kind != "response" else None))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"payload_bytes": "Int64", "page_id": "Int64"})
    return read


def read_warc(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``folder``; ``with_payload`` false leaves response bodies in the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInPandas(_records(with_payload), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """Join request, response (or revisit) and metadata records through their concurrent-to identifiers.

    One nested row per capture: page_id, request, response, metadata (each a struct of its record). A request or
    metadata record of the wrong target is left out, a capture without them has nulls there. Repeated records of a
    kind: the smallest body counts.
    """
    core = F.struct("record_id", "kind", "uri", "content_type", "refers_to", "payload_digest", "payload_bytes", "body")
    keyed = records.select(F.coalesce("concurrent_to", "record_id").alias("capture"), "kind", "page_id", core.alias("r"))
    main = keyed.where("kind IN ('response', 'revisit')").select("capture", F.col("r").alias("response"))
    side = (keyed.where("kind IN ('request', 'metadata')").groupBy("capture")
            .agg(F.min(F.when(F.col("kind") == "request", F.col("r"))).alias("request"),
                 F.min(F.when(F.col("kind") == "metadata", F.col("r"))).alias("metadata"), F.min("page_id").alias("page_id")))
    return main.join(side, "capture", "left").select("page_id", "request", "response", "metadata")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back and report each capture's payload and kind."""
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder)
    r = F.col("response")
    return captures(read_warc(spark, folder, with_payload=False)).select(
        "page_id", r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"), r["kind"].alias("record_type"),
        F.regexp_extract(r["refers_to"], r"(-?\d+)$", 1).cast("long").alias("refers_to"))


#: DuckDB has sha1 as hex; base32 takes five bits of it at a time.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hexed AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
first AS (SELECT hex, payload_bytes, min(page_id) AS f FROM hexed GROUP BY ALL),
bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(hex, i, 1)) - 1), 4, '0')), 'string_agg', '') AS b
         FROM hexed JOIN first USING (hex, payload_bytes))
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, 5 * i + j + 1, 1) AS INT) * (16 >> j)))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to
FROM bits"""
