"""WARC archives: written from pages, read back, and assembled into one row per capture.

A capture is three records: request, response (or revisit) and metadata; request and metadata name the response's record
in WARC-Concurrent-To. Archives are written by Spark's text sink, whose line separator is the blank lines that end a WARC
record, so the files go through Spark's own commit protocol into any store; they are compressed and of bounded length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize, new_path, tune

CRLF = "\r\n"
LEAST_REVISIT_BYTES = 100
#: Captures per archive file.
CAPTURES_PER_FILE = 1000
#: A fixed date, as pages carry none.
WARC_DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, payload_digest string, payload_bytes long, fields string, payload binary"


def record_id(kind: str, page: Column, nth: Column) -> Column:
    """A URN that is the same in every run: the MD5 of kind, page and occurrence in UUID form."""
    h = F.md5(F.concat_ws("/", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), nth.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _one_line(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x20]+", "%20")


def _record(kind: str, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """Header lines, blank line and block; the blank lines behind a record are the sink's separator."""
    parts: list[Column] = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {WARC_DATE}{CRLF}")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit("")))
    parts += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block]
    return F.concat(*parts)


def plan_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, bytes, digest, nth (occurrence of the page_id), first (page_id that holds the payload).

    Pages with equal payloads of at least LEAST_REVISIT_BYTES bytes share `first`, the smallest page_id. Null html is an
    empty payload. Rows that repeat a page_id are captures of their own; a null page_id is `first` only where no other page
    has the payload, and then all of these are responses.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    own = own.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    # Without the payloads: which pages repeat an earlier one. Minima are taken before the shuffle, so copies of one page
    # arrive as a few rows; only pages of payloads with copies are joined back.
    narrow = materialize(own.select("page_id", "digest", "bytes").where(F.col("bytes") >= LEAST_REVISIT_BYTES), "warc-digests")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = materialize(firsts, "warc-firsts")
    again = narrow.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", F.struct("digest", "first").alias("r"))
    again = materialize(again, "warc-revisits").groupBy(F.col("page_id").alias("r_page")).agg(F.map_from_entries(F.collect_set("r")).alias("firsts"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("digest", "url"))
    # Joined by page_id alone, so that the window needs no second shuffle of the payloads.
    joined = own.join(again, F.col("page_id").eqNullSafe(F.col("r_page")), "left").withColumn("first", F.element_at("firsts", F.col("digest")))
    return joined.drop("r_page", "firsts").withColumn("nth", nth)


def render(captures: DataFrame) -> DataFrame:
    """One row per capture: the text of its three records, with the separator between them."""
    own, first = record_id("response", F.col("page_id"), F.col("nth")), record_id("response", F.col("first"), F.lit(1))
    uri, digest = _one_line(F.col("url")), F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    response = _record("response", [("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], F.concat(http, "payload"))
    revisit = _record("revisit", [("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE), ("WARC-Refers-To", first), ("Content-Type", "application/http; msgtype=response")], http)
    request = _record("request", [("WARC-Record-ID", record_id("request", F.col("page_id"), F.col("nth"))), ("WARC-Concurrent-To", own), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF), F.when(F.col("first").isNotNull(), F.concat(F.lit("refers-to-page-id: "), F.col("first").cast("string"), F.lit(CRLF))).otherwise(F.lit("")))
    metadata = _record("metadata", [("WARC-Record-ID", record_id("metadata", F.col("page_id"), F.col("nth"))), ("WARC-Concurrent-To", own), ("WARC-Target-URI", uri), ("Content-Type", "application/warc-fields")], about)
    between = F.lit(CRLF + CRLF)
    return captures.select(F.concat(request, between, F.when(F.col("first").isNotNull(), revisit).otherwise(response), between, metadata).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages as gzip-compressed WARC files under path, at most CAPTURES_PER_FILE captures each."""
    out = render(plan_captures(pages)).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    out.option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)


def parse(content: bytes, payloads: bool = True) -> Iterator[tuple]:
    """The records of an archive as rows of RECORDS. Lengths come from Content-Length alone: payloads may hold anything,
    blank lines and text that looks like a record included. A record that ends early ends the archive."""
    data, at = memoryview(_inflate(content)), 0
    raw = data.obj
    while at < len(raw):
        while raw[at : at + 2] == b"\r\n":
            at += 2
        stop = raw.find(b"\r\n\r\n", at)
        if stop < 0 or not raw.startswith(b"WARC/", at):
            return
        head = {}
        for line in raw[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        length = int(head.get(b"content-length", "-1"))
        block = raw[stop + 4 : stop + 4 + max(length, 0)]
        if length < 0 or len(block) < length:
            return
        at = stop + 4 + length
        kind, payload, n, digest = head.get(b"warc-type", ""), None, None, None
        if kind in ("response", "revisit"):
            lines, _, payload = block.partition(b"\r\n\r\n")
            said = next((int(x.split(b":")[1]) for x in lines.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
            if kind == "response":
                n, digest = len(payload), hashlib.sha256(payload).hexdigest()
            else:
                n, digest, payload = said, head.get(b"warc-payload-digest", "").removeprefix("sha256:"), None
        fields = block.decode("utf-8", "replace") if kind in ("metadata", "warcinfo", "request") else None
        yield (
            head.get(b"warc-record-id"), kind, head.get(b"warc-concurrent-to"), head.get(b"warc-refers-to"), head.get(b"warc-target-uri"),
            head.get(b"warc-date"), digest, n, fields, payload if payloads else None,
        )


def _inflate(content: bytes) -> bytes:
    """Gzip members one after the other, or the content itself if it isn't gzip."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(content))
        content = z.unused_data
    return b"".join(out)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under path. Without payloads, their lengths and digests are still taken from the bytes."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                size = 0
                for r in parse(content.as_py(), payloads):
                    rows.append(r)
                    size += len(r[-1] or b"") + 200
                    if size > 4 << 20:
                        yield _batch(rows, names)
                        rows, size = [], 0
                yield _batch(rows, names)

    tune(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), kinds, strict=True)], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, uri, date, request, response, metadata.

    A capture is a response or revisit with the records that are concurrent to it. Requests and metadata arrive under the
    identifier that they name, responses under their own, so one grouping by capture joins all three; a part that is
    missing is null, of repeated parts the one with the smallest record identifier stays. Records concurrent to nothing
    that is there make a capture without response.
    """
    is_response = F.col("type").isin("response", "revisit")
    keyed = records.where(is_response | F.col("type").isin("request", "metadata")).withColumn("capture_id", F.when(is_response, F.col("record_id")).otherwise(F.col("concurrent_to")))
    body = F.struct("record_id", "type", "refers_to", "uri", "date", "payload_digest", "payload_bytes", "fields", "payload")

    def part(test: Column) -> Column:
        return F.min_by(F.when(test, body), F.when(test, F.col("record_id")))

    grouped = keyed.where(F.col("capture_id").isNotNull()).groupBy("capture_id").agg(part(F.col("type") == "request").alias("request"), part(is_response).alias("response"), part(F.col("type") == "metadata").alias("metadata"))
    return grouped.select("capture_id", F.coalesce("response.uri", "request.uri", "metadata.uri").alias("uri"), F.coalesce("response.date", "request.date").alias("date"), "request", "response", "metadata")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read and assemble them, and say for each page what its capture is.

    page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response for revisits), uri.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    c = assemble(read_records(spark, path, payloads=False))
    page = F.regexp_extract("metadata.fields", r"(?m)^page-id: (-?[0-9]+)", 1)
    first = F.regexp_extract("metadata.fields", r"(?m)^refers-to-page-id: (-?[0-9]+)", 1)
    return c.select(
        page.try_cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", first.try_cast("long")).alias("refers_to"), "uri",
    )
