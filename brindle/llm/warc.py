"""WARC archives of pages, and their transactions assembled again.

Writing makes one request, one response (or revisit) and one metadata record a
page as text rows; Spark's text sink writes them gzip-compressed into shared
storage. Reading parses each archive by its Content-Length headers and joins
the three records of a capture through their concurrent-to identifiers into
one nested row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import hot_join, small, work_dir, written

#: Payloads from this size on are written once.
LEAST_BYTES = 1000
#: Bytes of payload in an archive, on average; pages go to archives of pages of about their size, so that none has many times as many.
ARCHIVE_BYTES = 16 << 20
#: Pages from each of these numbers of bytes on, up to the next, share archives.
SIZE_CLASSES = [0, 1 << 16, 1 << 20, 1 << 24]
CRLF = "\r\n"
#: Profile of revisit records for equal payloads, as the WARC standard names it.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_bytes long, payload_digest string, content_type string, payload binary"
FIELDS = [x.split()[0] for x in RECORD.split(", ")]


def record_id(kind: str, row: Column, page_id: Column) -> Column:
    """An identifier of a row's record: the row's number, and its page for readers."""
    return F.concat(F.lit(f"<urn:capture:{kind}:"), row.cast("string"), F.lit(":"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record; a header whose value is null is left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v, F.lit(CRLF)), F.lit("")) for k, v in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, size, block, F.lit(CRLF + CRLF))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with row (a number of their own), payload, payload_bytes, payload_digest, and to_row and to_page (null: write as response)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    base = work_dir(pages.sparkSession)
    # the numbers hold for later steps as they are written once
    rows = written(rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"), "row": F.monotonically_increasing_id()}), f"{base}/rows")
    large = rows.where(F.col("payload_bytes") >= LEAST_BYTES).select("row", "page_id", "payload_digest")
    equal = written(large.groupBy("payload_digest").agg(F.max(F.struct("page_id", "row")).alias("to"), F.count("*").alias("n")).where("n > 1"), f"{base}/equal")
    revisits = hot_join(large, equal, "payload_digest", "n").where("row <> to.row").select("row", F.col("to.row").alias("to_row"), F.col("to.page_id").alias("to_page"))
    return rows.join(small(written(revisits, f"{base}/revisits")), "row", "left")


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a request, a response or revisit, and a metadata record for every row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least LEAST_BYTES bytes, one with the
    largest page_id is written as response, the others as revisits of it, be
    their page_id the same or not. A null html is an empty payload, a null url
    an empty target; a null page_id is smaller than all others and left out of
    the metadata. Other columns are not read. A payload is one value, so it may
    have up to 2 GB; large ones go to archives of few.
    """
    c = captures(pages)
    page, digest, to = F.col("page_id"), F.col("payload_digest"), F.col("to_row")
    kind = F.when(to.isNull(), "response").otherwise("revisit")
    ident = lambda what: record_id(what, F.col("row"), page)
    own = ident("response")
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    request = record([("WARC-Type", "request"), ("WARC-Record-ID", ident("request")), ("WARC-Concurrent-To", own), *common,
        ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.col("url"),
        F.lit(f" HTTP/1.1{CRLF}Accept: text/html{CRLF}{CRLF}")))
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    response = record(
        [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", F.when(to.isNotNull(), record_id("response", to, F.col("to_page")))), ("WARC-Profile",
            F.when(to.isNotNull(), PROFILE)), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), ("Content-Type",
            "application/http; msgtype=response")],
        F.when(to.isNull(), F.concat(http, "payload")).otherwise(http),
    )
    number = F.coalesce(F.concat(F.lit("page-id: "), page.cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", ident("metadata")), ("WARC-Concurrent-To", own), *common,
        ("Content-Type", "application/warc-fields")], F.concat(number, F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF)))
    # the sink ends each row with the line end that also ends the last record
    text = F.concat(request, response, F.substring(metadata, F.lit(1), F.length(metadata) - 2))
    size = sum((F.when(F.col("payload_bytes") >= n, 1).otherwise(0) for n in SIZE_CLASSES), F.lit(0))
    mode = "overwrite"
    for number_of, mean in sorted(c.groupBy(size.alias("size")).agg(F.avg("payload_bytes")).collect()) or [(1, 0)]:
        some = c.where(size == number_of).select(text).write.mode(mode).option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (mean + 1000))))
        some.option("lineSep", CRLF).option("compression", "gzip").text(path)
        mode = "append"


def parse(raw: bytes, keep_payload: bool = False) -> Iterator[tuple]:
    """Records of one archive, plain or gzip-compressed; RuntimeError where it is damaged."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:  # an archive may be a row of gzip members
            member = zlib.decompressobj(31)
            parts.append(member.decompress(raw))
            raw = member.unused_data
        raw = b"".join(parts)
    at, end = 0, len(raw)
    while at < end:
        stop = raw.find(b"\r\n\r\n", at)
        if stop < 0 or not raw.startswith(b"WARC/", at):
            raise RuntimeError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw[at:stop].decode("utf-8", "replace").split(CRLF)[1:])
        size = int(head["Content-Length"])
        block = raw[stop + 4 : stop + 4 + size]
        at = stop + 8 + size
        if len(block) < size or raw[at - 4 : at] != b"\r\n\r\n":
            raise RuntimeError(f"a record is cut off at byte {stop}")
        kind, payload = head["WARC-Type"], None
        page, n, digest = None, None, head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            n, real = len(payload), hashlib.sha1(payload).hexdigest()
            if digest not in (None, real):
                raise RuntimeError(f"{head['WARC-Record-ID']}: the payload doesn't have its digest")
            digest = real
        elif kind == "metadata" and head.get("Content-Type") == "application/warc-fields":
            fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(CRLF) if ": " in x)
            page = int(fields["page-id"]) if "page-id" in fields else None
            n = int(fields["payload-bytes"]) if "payload-bytes" in fields else None
        yield head["WARC-Record-ID"], kind, head.get("WARC-Concurrent-To"), head.get("WARC-Refers-To"), head.get("WARC-Target-URI"), page, n, digest, head.get("Content-Type"), payload if keep_payload else None


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row for each record of the archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.binary()]
        for batch in batches:
            for raw in batch.column(0):
                rows = list(parse(raw.as_py(), keep_payload))
                for lo in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 2000], strict=True), types, strict=True)], names=FIELDS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: record_id, request, response and metadata structs.

    Requests and metadata records join the response or revisit that they are
    concurrent to; what a capture lacks is null. Records that repeat an
    identifier are one. Requests without a response are left out.
    """
    part = lambda kinds, *cols: records.where(F.col("type").isin(*kinds)).select("record_id", *cols).dropDuplicates(["record_id"])
    response = part(("response", "revisit"), "type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "content_type", "payload")
    joined = response.select("record_id", F.struct(*response.columns).alias("response"))
    for kind in ("request", "metadata"):
        other = part((kind,), "concurrent_to", "target_uri", "page_id", "payload_bytes", "content_type")
        other = other.select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target_uri", "page_id", "payload_bytes", "content_type").alias(kind)).dropDuplicates(["record_id"])
        joined = joined.join(other, "record_id", "left")
    return joined.select("record_id", "request", "response", "metadata")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder, read the archives back, and give a digest of every capture, one for each row of ``pages``."""
    path = f"{work_dir(pages.sparkSession)}/warc"
    write_archives(pages, path)
    t = transactions(read_records(pages.sparkSession, path))
    referred = F.nullif(F.regexp_extract("response.refers_to", r"^<urn:capture:response:\d+:(-?\d*)>$", 1), F.lit(""))
    return t.select(F.col("metadata.page_id").alias("page_id"), F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", referred.cast("long")).alias("refers_to"))
