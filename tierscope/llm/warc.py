"""WARC writing, reading and transaction assembly.

Archives are written by Spark's text writer: a record is a line that ends with
the two line breaks which close every WARC record, so files are committed like
any other output and a lost executor's task is simply run again. Files are
gzip-compressed and therefore read whole and in order by one task each; the
reader goes by Content-Length, so payloads may hold any separator.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.llm.common import column, shared_folder

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(binary: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hexadecimal digits, ten at a time."""
    digest = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(row: Column, kind: str) -> Column:
    """A record id, a UUID made of the row's number and the record's kind."""
    h = F.md5(F.concat(row.cast("string"), F.lit(f"/{kind}")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _head(kind: Column | str, record_id: Column, uri: Column, content: str, length: Column,
          *extra: tuple[str, Column]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id,
                      F.lit(f"\r\nWARC-Date: {DATE}\r\n"))]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
              for name, value in [("WARC-Target-URI", uri), *extra]]
    return F.concat(*lines, F.lit(f"Content-Type: {content}\r\nContent-Length: "),
                    length.cast("string"), F.lit(END))


def write(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """One request, one response or revisit and one metadata record per page.

    Of pages with equal payloads of at least ``min_payload`` bytes, the one with
    the largest page_id (ties: the last row) is the response and the others
    revisit it; smaller payloads are all responses. A null html is an empty
    payload, a null id counts as the smallest, a null url is left out; control
    characters and blanks of a url are percent-encoded. ``pages`` is read twice
    and has to return its rows in the same order, as files do.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("payload"), F.monotonically_increasing_id().alias("row")
    ).withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn(
        "digest", base32_sha1(F.col("payload").cast("binary")))
    first = (rows.where(F.col("bytes") >= min_payload).groupBy("digest", "bytes")
             .agg(F.max(F.struct("page_id", "row")).alias("chosen"), F.count("*").alias("n"))
             .where("n > 1").select("digest", "bytes", F.col("chosen.row").alias("kept")))
    r = rows.join(first, ["digest", "bytes"], "left").withColumn(
        "again", F.coalesce(F.col("kept") != F.col("row"), F.lit(False)))
    uri = F.col("url")
    for c in [*range(0x21), 0x7F]:
        uri = F.replace(uri, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    uri = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), uri).otherwise(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    capture = _urn(F.col("row"), "response")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    get = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, F.col("payload")))
    fields = F.concat(F.lit("format: html\r\n"), F.coalesce(
        F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")))
    request = F.concat(_head("request", _urn(F.col("row"), "request"), uri,
                             "application/http; msgtype=request", F.octet_length(get),
                             ("WARC-Concurrent-To", capture)), get)
    response = F.concat(_head(
        F.when(F.col("again"), "revisit").otherwise("response"), capture, uri,
        "application/http; msgtype=response", F.octet_length(block), ("WARC-Payload-Digest", digest),
        ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(F.col("again"), _urn(F.col("kept"), "response")))), block)
    metadata = F.concat(_head("metadata", _urn(F.col("row"), "metadata"), uri, "application/warc-fields",
                              F.octet_length(fields), ("WARC-Concurrent-To", capture)), fields)
    (r.select(F.explode(F.array(request, response, metadata)).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(path))


_RECORD = pa.schema([
    ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()),
    ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
_RECORD_SQL = ("type string, record_id string, concurrent_to string, refers_to string, uri string, "
               "date string, digest string, payload_bytes bigint, payload binary, fields map<string,string>")


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class _Records:
    """Cuts a stream of segments, each of which was followed by ``END``, into
    records by their Content-Length."""

    def __init__(self):
        self.head: dict | None = None
        self.block: list[bytes] = []
        self.held = self.length = 0

    def push(self, segment: bytes):
        if self.head is None:
            segment = segment.lstrip(b"\r\n")
            if not segment:
                return None
            if not segment.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {segment[:40]!r}")
            self.head, self.block, self.held = _headers(segment), [], 0
            self.length = int(self.head["content-length"])
            return None
        self.block += [segment, END.encode()]
        self.held += len(segment) + len(END)
        if self.held < self.length:
            return None
        head, block = self.head, b"".join(self.block)[:self.length]
        self.head = None
        return head, block


def _record(head: dict, block: bytes, with_payload: bool) -> tuple:
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest")
    payload, size, fields = None, None, None
    if kind in ("response", "revisit"):
        http, _, body = block.partition(END.encode())
        size = int(_headers(http).get("content-length", len(body)))
        if kind == "response":
            got = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            if size != len(body) or (digest or got) != got:
                raise ValueError(f"payload and digest of {head.get('warc-record-id')} differ")
            digest, payload = got, body if with_payload else None
    elif kind == "metadata":
        fields = list(_headers(b"\r\n" + block).items())
    return (kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"),
            head.get("warc-target-uri"), head.get("warc-date"), digest, size, payload, fields)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of gzip-compressed archives. A response whose payload
    and digest differ raises an error."""
    lines = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("raw"))

    def run(batches):
        records = _Records()
        for batch in batches:
            out = []
            for segment in column(batch, "raw"):
                if (found := records.push(segment)) is not None:
                    out.append(_record(*found, with_payload))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], f.type) for k, f in enumerate(_RECORD)], schema=_RECORD)
        if records.head is not None:
            raise ValueError("an archive ends inside a record")

    return lines.mapInArrow(run, _RECORD_SQL)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit joined with the request
    and metadata records that name it (or its request) in WARC-Concurrent-To.

    ``record_id, uri, date, type, digest, payload_bytes, payload, refers_to`` of the
    response; ``requests`` and ``metadata``: arrays, empty without such records.
    A record that names none, or one that isn't there, starts a row of its own
    (type null). Records per capture are few by format; keys are record ids.
    """
    requests = records.where("type = 'request' and concurrent_to is not null").select(
        F.col("record_id").alias("via"), F.col("concurrent_to").alias("capture_of"))
    main = records.where("type in ('response', 'revisit')").select(
        F.col("record_id").alias("capture"), F.struct(
            "record_id", "uri", "date", "type", "digest", "payload_bytes", "payload", "refers_to").alias("m"))
    rest = records.where("type not in ('response', 'revisit')")
    by_request = rest.join(requests, F.col("concurrent_to") == F.col("via"), "left").select(
        F.coalesce("capture_of", "concurrent_to", "record_id").alias("capture"),
        F.when(F.col("type") == "request", F.struct("record_id", "uri", "date")).alias("request"),
        F.when(F.col("type") == "metadata", F.struct("record_id", "fields")).alias("meta"))
    own = by_request.groupBy("capture").agg(
        F.collect_list("request").alias("requests"), F.collect_list("meta").alias("metadata"))
    joined = main.join(own, "capture", "full")
    return joined.select(
        F.col("capture").alias("record_id"),
        *[F.col(f"m.{c}").alias(c) for c in ("uri", "date", "type", "digest", "payload_bytes", "payload", "refers_to")],
        *[F.when(F.col(c).isNull(), F.array()).otherwise(F.col(c)).alias(c) for c in ("requests", "metadata")])


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
