"""WARC archives with revisit records for repeated payloads, written and read by Spark."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantloom.llm.common import q, stored, table
from plantloom.session import scratch_path

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc-revisit/1.1/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BREAK = "\r\n"


def base32_sha1(payload):
    """SHA-1 of a binary column in base 32: each 5 hexadecimal digits are 4 of its 32 letters."""
    digits = F.sha1(payload)
    letters = []
    for g in range(8):
        number = F.conv(F.substring(digits, 1 + 5 * g, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1))
                    for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _line(name: str, value):
    """A header line; nothing where the value is NULL. Line breaks in values become spaces."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(BREAK)), F.lit(""))


def _record_id(page, digest):
    h = F.md5(F.concat_ws("|", page.cast("string"), digest).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", min_bytes: int = 0, records_per_file: int = 5000,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one record per row as gzip-compressed archives below ``path``.

    Of the rows with equal payloads of at least ``min_bytes`` the one with the smallest id is a
    response with the payload; the others are revisits, which carry the digest, name the response
    and have no payload. Smaller payloads are all responses. The payload is the page in UTF-8; a
    NULL page is an empty one. Rows that repeat both id and payload are the same capture and take
    the same type. A NULL id is never the smallest unless all ids of a payload are NULL; those are
    responses. A NULL address has no address line. An empty table writes no record; other columns
    are not read. A task holds a page at a time while it writes, and a whole archive, unpacked,
    while it reads: with very long pages take a smaller ``records_per_file``.
    """
    text = F.coalesce(q(html_col).cast("string"), F.lit(""))
    rows = pages.select(q(id_col).alias("id"), q(url_col).alias("url"), text.alias("page")).select(
        "*", F.octet_length("page").alias("size"),
        base32_sha1(F.col("page").cast("binary")).alias("digest"))
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(firsts, "digest", "left")
    again = (F.col("size") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(
        F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"
                          "Content-Length: "), F.col("size").cast("string"), F.lit(BREAK * 2))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("page")))
    rid, original = _record_id(F.col("id"), F.col("digest")), _record_id(
        F.col("first"), F.col("digest"))
    head = F.concat(
        F.lit(f"{VERSION}{BREAK}"),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", rid), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")), _line("X-Page-Id", F.col("id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(again, original)),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)), F.lit(BREAK), block)
    rows.select(head.alias("value")).write.option("lineSep", BREAK * 2).option(
        "compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records(data: bytes):
    """(header fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(BREAK)
        if version != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop: stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length than it says")
        yield fields, data[start:stop]
        at = stop + 4


def _read(batches):
    for batch in batches:
        for content in batch.column(0):
            out = []
            for f, block in records(gzip.decompress(content.as_py())):
                payload = block[block.index(b"\r\n\r\n") + 4:]
                digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = f["WARC-Type"]
                if kind == "response":
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if own != digest:
                        raise ValueError(f"{f['WARC-Record-ID']} holds another payload")
                out.append((f["WARC-Record-ID"], f.get("X-Page-Id"), f.get("WARC-Target-URI"), kind,
                            digest, f.get("WARC-Refers-To"),
                            payload.decode() if kind == "response" else None))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in cols],
                names=["record_id", "id", "url", "record_type", "digest", "original", "page"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``: their fields, and the page of a response (verified digest)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(
        _read, "record_id string, id string, url string, record_type string, digest string,"
               " original string, page string")


def resolved(found: DataFrame) -> DataFrame:
    """Records with the payload size and page id of the response that each revisit names.

    Only revisits are joined, by the record they name; responses have their own size.
    """
    own = stored(found.select("*", F.octet_length("page").cast("long").alias("bytes"))
                 .drop("page", "url"), "warc-records")
    answers = own.where("record_type = 'response'")
    named = answers.groupBy(F.col("record_id").alias("original")).agg(
        F.first("id").alias("refers_to"), F.first("bytes").alias("payload_bytes"))
    revisits = own.where("record_type <> 'response'").join(named, "original", "left")
    shape = ["id", "payload_bytes", "digest", "record_type", "refers_to"]
    return answers.select(
        "id", F.col("bytes").alias("payload_bytes"), "digest", "record_type",
        F.lit(None).cast("string").alias("refers_to"),
    ).union(revisits.select(*shape)).withColumnRenamed("digest", "payload_digest")


def op8_warc_revisits(spark, sf: str) -> DataFrame:
    """All pages written as archives, read back, and resolved."""
    pages = table(spark, sf, "pages")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return resolved(read_archives(spark, path)).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
