"""WARC archives: transactions written as request, response (or revisit) and metadata records, read back and assembled.

Writing: every capture gives three records of one concurrency group; request and metadata name the response in
WARC-Concurrent-To.  Of captures with equal payloads of at least ``min_revisit`` bytes the one with the smallest id keeps
its payload; the others become revisit records that refer to it.  Spark's text writer puts the records out, gzipped, one
file a task, ended by the blank lines that end a WARC record.

Reading: the text reader hands over the pieces between blank lines in order; Content-Length says how many make a record,
so payloads may hold blank lines or whole WARC records.  Any gzipped archive is one task, streamed record by record;
plain archives must be no longer than one split.

Assembling: records join through the identifiers they are concurrent to, over up to ``hops`` steps, and one nested row
comes out per capture.

Scale: equal payloads are found by an aggregate of digests, combined in the map tasks; only digests that repeat are
joined back, so a payload that a third of all pages share is one small row, and its pages are not moved to one task
(Spark splits that join's large partitions).  Payloads themselves are not shuffled unless the caller asks for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, cut, pick

MIN_REVISIT = 100
BLANK = b"\r\n\r\n"
_BLANK = BLANK.decode()
_FIRST = re.compile(rb"WARC/1\.[01]\r\n")
RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "content_type string, payload_digest string, payload_bytes long, http string, payload binary")


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines of the fields that are not null."""
    return F.concat_ws("\r\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in fields])


def _record(kind: Column, record_id: Column, block: Column, content_type: str, uri: Column, *more: tuple[str, Column]) -> Column:
    head = _lines(("WARC-Type", kind), ("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))),
                  ("WARC-Date", F.lit("2024-01-01T00:00:00Z")), ("WARC-Target-URI", uri), *more,
                  ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit(_BLANK), block)


def first_copies(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """digest, first: the smallest id of each payload of at least ``min_revisit`` bytes that occurs more than once."""
    long = pages.where(F.octet_length("payload") >= min_revisit).select(F.sha2("payload", 256).alias("digest"), "page_id")
    seen = long.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    return cut(seen.where("n > 1").select("digest", "first"), "first-copies")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_revisit: int = MIN_REVISIT) -> None:
    """Archive one capture per row.

    A null payload is empty and a null URL leaves the field out.  A null id is never referred to and refers to nothing.
    Rows that share id and payload are each a response, as none comes before the others."""
    src = pick(pages, page_id=id_col, url=url_col, payload=payload_col).withColumn("payload", F.coalesce("payload", F.lit("")))
    src = src.withColumn("digest", F.sha2("payload", 256)).withColumn("_n", F.monotonically_increasing_id())
    src = src.join(first_copies(src, min_revisit), "digest", "left")
    revisit = F.col("page_id") > F.col("first")
    revisit = F.coalesce(revisit, F.lit(False))
    page = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    # copies of an id are told apart by the part after #; references name the page alone
    whole = F.concat(page, F.lit("#"), F.col("_n").cast("string"))
    target = F.concat(F.lit("<"), whole, F.lit(":response>"))
    uri = F.regexp_replace("url", r"[\r\n]+", " ")
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(_BLANK))
    response = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.concat(whole, F.lit(":response")),
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))), "application/http; msgtype=response", uri,
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
    request = _record(F.lit("request"), F.concat(whole, F.lit(":request")), F.lit(f"GET / HTTP/1.1{_BLANK}"),
                      "application/http; msgtype=request", uri, ("WARC-Concurrent-To", target))
    fields = F.concat(_lines(("page-id", F.col("page_id").cast("string")), ("payload-bytes", size)), F.lit("\r\n"))
    metadata = _record(F.lit("metadata"), F.concat(whole, F.lit(":metadata")), fields, "application/warc-fields", uri,
                       ("WARC-Concurrent-To", target))
    records = src.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", _BLANK).option("compression", "gzip").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, as in ``RECORD``; ``http`` is the HTTP head, or the whole block of other records.

    Fields a record lacks are null.  A record cut short at the end of an archive raises."""
    bounded_batches(spark)
    lines = spark.read.option("lineSep", _BLANK).text(path)
    pieces = lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"),
                          F.col("_metadata.file_block_start").alias("start"))
    return pieces.mapInArrow(_parse, RECORD)


class _Framer:
    """Cuts a stream of bytes, fed piece by piece, into WARC records."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.need, self.fields = 0, 0, None

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.parts += [piece, BLANK]
        self.size += len(piece) + len(BLANK)
        while True:
            if self.fields is None:
                data = b"".join(self.parts).lstrip(b"\r\n")
                head, blank, rest = data.partition(BLANK)
                if not blank:
                    self._keep(data)
                    return
                if not _FIRST.match(head + b"\r\n"):
                    raise ValueError("no WARC record where one should begin")
                self.fields = _fields(head)
                self.need = int(self.fields["content-length"]) + len(BLANK)
                self._keep(rest)
            if self.size < self.need:
                return
            data = b"".join(self.parts)
            yield self.fields, data[:self.need - len(BLANK)]
            self.fields = None
            self._keep(data[self.need:])

    def _keep(self, data: bytes) -> None:
        self.parts, self.size = [data], len(data)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary()]
    out: list[tuple] = []
    held, now, framer = 0, None, _Framer()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for b in batches:
        for piece, file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if file != now:
                if framer.fields is not None:
                    raise ValueError(f"{now} ends within a record")
                if start:
                    raise ValueError(f"{file} is plain and longer than a split: gzip it or raise spark.sql.files.maxPartitionBytes")
                now, framer = file, _Framer()
            for fields, block in framer.feed(piece):
                out.append(_row(fields, block))
                held += len(block)
                if held > 4 << 20 or len(out) >= 5000:
                    yield batch()
                    out, held = [], 0
    if framer.fields is not None:
        raise ValueError(f"{now} ends within a record")
    if out:
        yield batch()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _row(f: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(BLANK) if f.get("content-type", "").startswith("application/http") else (block, b"", b"")
    size = _fields(http).get("content-length") if f.get("warc-type") in ("response", "revisit") else None
    name = lambda k: f[k].strip("<>") if k in f else None
    return (name("warc-record-id"), f.get("warc-type"), name("warc-concurrent-to"), name("warc-refers-to"), f.get("warc-target-uri"),
            f.get("warc-date"), f.get("content-type"), f["warc-payload-digest"].removeprefix("sha256:") if "warc-payload-digest" in f else None,
            int(size) if size is not None and size.isdigit() else None, http.decode("utf-8", "replace"), payload)


def captures(records: DataFrame, hops: int = 1) -> DataFrame:
    """One row per response or revisit: capture_id, response, request and metadata (arrays of structs).

    A record belongs to the capture it is concurrent to, directly or over ``hops`` further records.  A response that is
    concurrent to nothing opens a capture; requests and metadata that lead to none are left out, captures without them
    have empty arrays.  read_bytes and read_digest are those of the body as read (no digest for a revisit)."""
    main = F.col("type").isin("response", "revisit")
    up = F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))
    linked = records.withColumn("capture_id", up)
    if hops > 1:
        links = records.where(~main).select(F.col("record_id").alias("_from"), F.col("concurrent_to").alias("_to"))
        for _ in range(hops - 1):
            linked = linked.join(links, linked["capture_id"] == links["_from"], "left").withColumn(
                "capture_id", F.coalesce("_to", "capture_id")).drop("_from", "_to")
    side = lambda kind: F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", "target_uri", "date", "http")))
    of = lambda c: F.max(F.when(main, F.col(c)))
    read_digest = F.when(F.col("type") == "response", F.sha2("payload", 256))
    linked = linked.withColumn("read_digest", read_digest).withColumn("read_bytes", F.octet_length("payload").cast("long"))
    out = linked.groupBy("capture_id").agg(
        *[of(c).alias(c) for c in ("type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "read_bytes", "read_digest", "http", "payload")],
        side("request").alias("requests"), side("metadata").alias("metadata"))
    response = F.struct("type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "read_bytes", "read_digest", "http", "payload")
    return out.where("type IS NOT NULL").select("capture_id", response.alias("response"), "requests", "metadata")
