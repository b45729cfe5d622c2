"""A content-addressed web archive.

Payloads are stored once, under their SHA-256; records keep their exact WARC
headers and name their payload by digest.  Reading verifies every payload
against its digest and joins records and payloads again; the original records,
byte for byte, are header + payload + two line ends.

Of records with equal payloads (of at least ``min_bytes``) the one with the
largest id is the response and the others are revisits of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .runtime import bare, place, ship, written

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH = "1970-01-01T00:00:00Z"
_RUN = 10_000


def base32_of_hex(digest: Column, n_hex: int = 40) -> Column:
    """Base32 of a hex digest whose length is a multiple of five digits (20 bits)."""
    groups = []
    for at in range(0, n_hex, 5):
        bits = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        groups += [F.substr(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*groups)


def _safe(text: Column) -> Column:
    """A header value: per cent, tab, line ends and blanks percent-encoded."""
    out = text.cast("string")
    for c in "%\t\n\r <>":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    *,
    min_bytes: int = 0,
    filter_bits: int = 1 << 23,
) -> None:
    """Write the archive folders ``records`` and ``payloads`` below ``path``.

    There is a record for every row.  Payloads are the column's bytes (UTF-8 for
    strings; null: empty).  Records with equal payloads of ``min_bytes`` or more:
    the largest id is the response (nulls last, then the largest URL, then one of
    the equal rows), the others revisit it; smaller payloads are all responses.
    Line ends, tabs, blanks, ``%``, ``<`` and ``>`` in ids and URLs are
    percent-encoded in headers.

    Digests are shuffled, and of payloads only those that may occur again: a
    bitmap of ``filter_bits`` marks the shared digests, and what it does not mark
    is written by the task that reads it.  Of the others each task sends one.
    Repeated rows come out in runs of bounded length.
    """
    payload = F.coalesce(place(pages, payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = bare(pages).select(place(pages, id_col).alias("id"), place(pages, url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    seen = rows.select("id", "url", "sha256", F.octet_length("payload").cast("bigint").alias("size"), F.sha1("payload").alias("sha1"))
    equal = written(seen.groupBy("id", "url", "sha256", "size", "sha1").agg(F.count(F.lit(1)).alias("n")), "warc-seen")
    per = equal.groupBy("sha256").agg(F.sum("n").alias("n"), F.max(F.struct("id", "url")).alias("top"))
    shared = written(per.filter("n > 1"), "warc-shared")

    place_of = F.pmod(F.xxhash64("sha256"), F.lit(filter_bits))
    word, bit = F.floor(place_of / 64), (place_of % 64).cast("int")
    mark = F.expr("shiftleft(1L, bit)")
    marks = shared.select(word.alias("word"), bit.alias("bit")).select("word", mark.alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks"))
    marked = rows.select("sha256", "payload", word.alias("word"), bit.alias("bit")).join(F.broadcast(marks), "word", "left")  # filter_bits / 64 rows at most
    again = F.coalesce(F.col("marks"), F.lit(0)).bitwiseAND(mark) != 0
    once = marked.filter(~again).select("sha256", "payload")
    some = marked.filter(again).select("sha256", "payload").dropDuplicates(["sha256"])
    once.unionByName(some).write.parquet(f"{path}/payloads")

    ranked = equal.join(shared.select("sha256", "top"), "sha256", "left")
    first = F.col("id").eqNullSafe(F.col("top.id")) & F.col("url").eqNullSafe(F.col("top.url"))
    alone = F.col("top").isNull() | (F.col("size") < min_bytes)
    runs = ranked.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _RUN))))
    copies = F.explode(F.sequence(F.col("run") * _RUN + 1, F.least(F.col("n"), (F.col("run") + 1) * _RUN))).alias("copy")
    each = runs.select("*", copies).withColumn("response", alone | (first & (F.col("copy") == 1)))
    target = F.when(~F.col("response"), F.col("top.id"))
    headers = _header(F.col("id"), F.col("copy"), F.col("url"), F.col("size"), F.col("sha1"), F.col("response"), target)
    each.select(headers.alias("header"), "sha256").write.parquet(f"{path}/records")


def _record_id(i: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(_safe(i), F.lit("")), F.lit(">"))  # without an id: empty


def _header(i: Column, copy: Column, url: Column, size: Column, sha1: Column, response: Column, target: Column) -> Column:
    """The record's header, up to and with the empty line."""
    line = "\r\n"
    return F.concat(
        F.lit("WARC/1.1" + line + "WARC-Type: "),
        F.when(response, "response").otherwise("revisit"),
        F.lit(f"{line}WARC-Record-ID: "), _record_id(i),
        F.when(copy > 1, F.concat(F.lit(f"{line}WARC-Copy: "), copy.cast("string"))).otherwise(""),
        F.lit(f"{line}WARC-Date: {EPOCH}"),
        F.when(url.isNull(), "").otherwise(F.concat(F.lit(f"{line}WARC-Target-URI: "), _safe(url))),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), base32_of_hex(sha1),
        F.when(response, "").otherwise(F.concat(F.lit(f"{line}WARC-Refers-To: "), _record_id(target), F.lit(f"{line}WARC-Profile: identical-payload-digest"))),
        F.lit(f"{line}Content-Length: "), F.when(response, size).otherwise(0).cast("string"),
        F.lit(line + line),
    )


def _field(name: str) -> Column:
    value = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(F.contains("header", F.lit(f"\r\n{name}: ")), value)


def _id_in(value: Column) -> Column:
    """The page id of a record id; null for the id of a page without one."""
    inner = F.regexp_extract(value, r"^<urn:page:(.*)>$", 1)
    for c in "<> \r\n\t%":
        inner = F.replace(inner, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(inner != "", inner)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records, each with its whole payload.

    Columns: ``page_id`` (string), ``url`` (as in the header), ``record_type``,
    ``refers_to``, ``payload_digest`` (base32 SHA-1), ``payload_bytes``,
    ``payload`` and ``header``.  Every payload is digested again: one whose
    SHA-256 or SHA-1 differs from what the record says stops the job, as does a
    record without payload.  Only the columns asked for are moved, so a reader
    of digests shuffles no payload.
    """
    kept = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    checked = kept.select(
        "sha256", "payload",
        F.sha2("payload", 256).alias("_sha256"), F.sha1("payload").alias("_sha1"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    )
    records = spark.read.schema("header string, sha256 string").parquet(f"{path}/records")
    joined = records.join(checked, "sha256", "left")
    said = _field("WARC-Payload-Digest")
    found = F.concat(F.lit("sha1:"), base32_of_hex(F.col("_sha1")))
    good = (F.col("_sha256") == F.col("sha256")) & (found == said)
    digest = F.when(F.coalesce(good, F.lit(False)), F.substring(said, 6, 32)).otherwise(
        F.raise_error(F.concat(F.lit("payload missing or changed: "), F.col("sha256")))
    )
    return joined.select(
        _id_in(_field("WARC-Record-ID")).alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        _id_in(_field("WARC-Refers-To")).alias("refers_to"),
        digest.alias("payload_digest"),
        "payload_bytes",
        "payload",
        "header",
    )


def record_bytes(rows: DataFrame) -> Column:
    """The original record of each row of ``read_archive``, byte for byte; a block
    whose length is not the header's Content-Length stops the job."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    said = F.regexp_extract("header", r"\r\nContent-Length: (\d+)\r\n", 1).cast("bigint")
    whole = F.concat(F.col("header").cast("binary"), block, F.lit("\r\n\r\n").cast("binary"))
    return F.when(F.octet_length(block) == said, whole).otherwise(F.raise_error(F.concat(F.lit("wrong length: "), F.col("header"))).cast("binary"))


def export_warc(spark: SparkSession, archive: str, path: str, *, max_records: int = 50_000) -> None:
    """Write the original records as WARC files on any Hadoop file system.

    A record is header, payload (of responses) and two line ends; the text
    writer's separator is those line ends, so it writes the bytes as they are.
    """
    rows = read_archive(spark, archive)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    record = F.concat(F.col("header").cast("binary"), body).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max_records).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of every record of a WARC file's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end]
        size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", header)[1])
        yield header, data[end : end + size]
        at = end + size + 4


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of every record of the WARC files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                found = list(parse_warc(data.as_py()))
                if found:
                    headers, blocks = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([h.decode() for h in headers]), pa.array(blocks)], names=["header", "payload"])

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "header string, payload binary")
