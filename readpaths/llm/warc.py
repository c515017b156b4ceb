"""WARC archives: writing captures, reading records back, assembling transactions.

A capture is three records: the request, the response (or a revisit of an
equal payload), and a metadata record; request and metadata name the response
in ``WARC-Concurrent-To``.  Archives are gzip-compressed WARC/1.1 files
written and read by Spark's text source, with the record boundary as line
separator, so any file system that Spark reads will do and a file streams
through its task.  Bodies that hold the boundary themselves are put together
again by their ``Content-Length``.

Records are assembled by one aggregation on the identifier they are concurrent
to, and a capture is one nested row.  Revisits find their payload by joining
``WARC-Refers-To`` with the responses.

Which row of equal payloads is the response -- the largest id -- is found on
digests only.  Pages are joined with the digests that occur more than once;
Spark broadcasts that table only below its own size threshold.

Cases: a null payload is empty; a null URL has no target URI; line breaks in a
URL are percent-encoded; a null id is never the largest unless all are null;
rows that repeat id and payload are written and assembled as often as they
occur, each as the same record (with the largest URL if those differ); an
empty table gives an empty archive and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readpaths.llm.shared import bounded_batches, shared_path, stored

CRLF = "\r\n"
BOUNDARY = "\r\n\r\n"
VERSION = "WARC/1.1\r\n"
RECORDS_PER_FILE = 30_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, "
          "payload_bytes long, digest_ok boolean, fields map<string,string>, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from Spark's hexadecimal one (five digits make four)."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, id_col: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + " "), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(" "), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the boundary after it; fields with a null value are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit(name + ": "), value, F.lit(CRLF)) for name, value in [("WARC-Type", kind), *fields, ("Content-Length", F.octet_length(block).cast("string"))]]
    return F.concat(F.lit(VERSION), F.concat_ws("", *lines), F.lit(CRLF), block)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a request, a response or revisit, and a metadata record for every row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    repeated = stored(rows.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top"), "payloads")
    typed = rows.join(repeated, "digest", "left").withColumn("response", F.expr("top is null or id <=> top"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    main = _record_id("response", F.col("id"), F.col("digest"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(BOUNDARY))
    is_response = F.col("response")
    captured = _record(F.when(is_response, "response").otherwise("revisit"), [
        ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Profile", F.when(~is_response, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.when(~is_response, _record_id("response", F.col("top"), F.col("digest")))),
        ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(head, F.when(is_response, F.col("payload")).otherwise(F.lit(""))))
    asked = F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1)
    request = _record("request", [("WARC-Record-ID", _record_id("request", F.col("id"), F.col("digest"))), *common, ("WARC-Concurrent-To", main),
                                  ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.when(asked == "", "/").otherwise(asked), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(BOUNDARY)))
    about = _record("metadata", [("WARC-Record-ID", _record_id("metadata", F.col("id"), F.col("digest"))), *common, ("WARC-Concurrent-To", main),
                                 ("Content-Type", F.lit("application/warc-fields"))],
                    F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF)))
    (typed.select(F.explode(F.array(request, captured, about)).alias("value")).write
     .option("lineSep", BOUNDARY).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name is not None:
            out[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            key, colon, value = line.partition(b":")
            if colon:
                name = key.strip().lower().decode("utf-8", "replace")
                out[name] = value.strip().decode("utf-8", "replace")
    return out


def records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of archive text (file, piece) that was cut at boundary and version line.

    A piece shorter than its record's ``Content-Length`` was cut inside the
    block and goes on in the next piece, which may hold the next record too; a
    record cut off by the end of its file is left out.
    """
    cut = (BOUNDARY + VERSION).encode()
    parts: list[bytes] = []
    fields, want, have, within = {}, 0, 0, None

    def whole():
        block = cut.join(parts)
        return block[:want] if len(block) >= want else None

    for file, piece in pieces:
        opens_file, within = file != within, file
        if parts and not opens_file and have < want:
            parts.append(piece)
            have += len(cut) + len(piece)
            if have <= want or not (text := cut.join(parts)).startswith(cut, want):
                continue
            # the block's end and the boundary made a cut together: the next record is in this piece
            yield fields, text[:want]
            parts, piece = [], text[want + len(cut) :]
        if parts and (block := whole()) is not None:
            yield fields, block
        head, _, block = (piece.removeprefix(VERSION.encode()) if opens_file else piece).partition(BOUNDARY.encode())
        fields = _fields(head)
        size = fields.get("content-length", "")
        want, have, parts = int(size) if size.isdigit() else len(block), len(block), [block]
    if parts and (block := whole()) is not None:
        yield fields, block


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = fields.get("warc-type")
    payload, digest_ok, extra = block, None, {}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(BOUNDARY.encode())[2]
    if kind == "metadata":
        extra = _fields(block)
    if kind == "response" and digest:
        digest_ok = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    return (fields.get("warc-record-id"), kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"),
            digest, len(payload), digest_ok, list(extra.items()), payload if with_payload else None)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (columns of ``RECORD``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for fields, block in records((f.as_py(), p.as_py()) for b in batches for f, p in zip(b.column("file"), b.column("value"), strict=True)):
            rows.append(_row(fields, block, with_payload))
            size += len(block) if with_payload else 0
            if size > 4 << 20 or len(rows) >= 5000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    bounded_batches(spark)
    lines = spark.read.option("lineSep", BOUNDARY + VERSION).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def transactions(archive: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, request, response, metadata`` (structs, null if absent).

    ``response`` holds the response or revisit record.  Records that name no
    other are captures of their own, under their own identifier.
    """
    row = F.struct(*[F.col(c) for c in archive.columns])
    role = F.when(F.col("type").isin("response", "revisit"), "response").otherwise(F.col("type"))

    def one(name):
        return F.max_by(F.when(role == name, row), F.when(role == name, F.coalesce("target_uri", F.lit("")))).alias(name)

    joined = archive.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        one("request"), one("response"), one("metadata"), F.count(F.when(role == "response", 1)).alias("copies"))
    return joined.select("capture_id", "request", "response", "metadata", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives, read them back and assemble: ``<id_col>, payload_bytes, payload_digest,
    record_type, refers_to`` (id of the response that a revisit refers to) and ``digest_ok``."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_captures(pages, path, id_col, url_col, payload_col)
    nested = transactions(read_records(spark, path, with_payload=False))
    page_id = F.nullif(F.element_at("metadata.fields", "page-id"), F.lit("")).cast("long")
    found = stored(nested.where("response is not null").select(
        page_id.alias("id"), "capture_id", "response.payload_bytes", "response.payload_digest", "response.type", "response.refers_to", "response.digest_ok", "copy"), "captures")
    responses = stored(found.where("type = 'response' and copy = 1").select(
        F.col("capture_id").alias("refers_to"), F.col("id").alias("response_id"), F.col("payload_bytes").alias("response_bytes"), F.col("digest_ok").alias("response_ok")), "responses")
    own = found.where("type = 'response'").select("id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "digest_ok")
    again = found.where("type = 'revisit'").join(responses, "refers_to").select(
        "id", F.col("response_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("response_id").alias("refers_to"), F.col("response_ok").alias("digest_ok"))
    return own.union(again).withColumnRenamed("id", id_col)
