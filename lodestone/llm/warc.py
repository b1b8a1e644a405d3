"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as a request, a response (or a revisit of an equal payload)
and a metadata record. Request and metadata name the response through
WARC-Concurrent-To; assembly joins the three by that and emits one nested row.
Archives are written and read by Spark's own file formats, so any file system
that Spark reaches will do.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.storage import broadcast_if_small
from lodestone.operators.lineage import checkpointed

VERSION = "WARC/1.1"
CRLF = "\r\n"
BETWEEN = CRLF + CRLF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always written out.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 24 << 20


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the blank lines behind it."""
    parts = [F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}")]
    for name, value in headers:
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(""))
    parts += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(BETWEEN), block]
    return F.concat(*parts)


def _urn(kind: str) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(kind), F.col("_row").cast("string"), F.col("page_id").cast("string"), F.col("digest")).cast("binary"))
    uuid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write each page as request, response or revisit, and metadata.

    Of equal payloads of at least 100 bytes the one with the smallest page_id is a
    response (so are rows that repeat that id), others revisit it. Null pages have an empty payload. Line ends in
    URLs become spaces. Other columns are ignored; an empty table gives empty archives.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    slim = pages.select(
        F.col(page_id).alias("page_id"), F.regexp_replace(F.col(url), "[\r\n]+", " ").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    size = F.octet_length("payload")
    sizes = slim.agg(F.count(F.lit(1)).alias("rows"), F.sum(size.cast("bigint") + 1_500).alias("bytes")).first()
    # The page with the least id of each payload that occurs again.
    origins = (
        slim.where(size >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(
            F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    repeated = broadcast_if_small(origins)
    captures = slim.join(repeated, "digest", "left").withColumn("_row", F.monotonically_increasing_id())
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    target, date = F.col("url"), F.lit("2024-01-01T00:00:00Z")
    address = F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:]*://([^/?#]*)", 1)
    place = F.regexp_replace(F.coalesce("url", F.lit("")), "^[^:]*://[^/?#]*", "")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(BETWEEN)
    )
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    common = [("WARC-Date", date), ("WARC-Target-URI", target)]
    request = _record(
        "request",
        [("WARC-Record-ID", _urn("request")), ("WARC-Concurrent-To", _urn("response")), *common,
         ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(f" HTTP/1.1{CRLF}Host: "), address, F.lit(BETWEEN)),
    )
    response = _record(
        "response",
        [("WARC-Record-ID", _urn("response")), *common, ("WARC-Payload-Digest", digest),
         ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(http, F.col("payload")),
    )
    revisit = _record(
        "revisit",
        [("WARC-Record-ID", _urn("response")), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit(REVISIT_PROFILE)),
         ("WARC-Refers-To-Target-URI", F.col("first_url")), ("WARC-Refers-To-Date", date),
         ("Content-Type", F.lit("application/http;msgtype=response"))],
        http,
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", _urn("metadata")), ("WARC-Concurrent-To", _urn("response")), *common,
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    lines = captures.select(
        F.concat(request, F.lit(BETWEEN), F.when(revisits, revisit).otherwise(response), F.lit(BETWEEN), metadata).alias("value")
    )
    most = max(1, int((sizes["rows"] or 0) * ARCHIVE_BYTES // max(sizes["bytes"] or 0, 1)))
    lines.write.option("lineSep", BETWEEN).option("maxRecordsPerFile", most).option("compression", "gzip").text(path)


RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, refers_to_uri string, declared_digest string, "
    "payload_bytes bigint, payload_digest string, fields map<string, string>"
)


def _fields(raw: bytes) -> dict[str, str]:
    """Header or field lines; names in lower case."""
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split(CRLF) if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def plain(archive: bytes) -> bytes:
    """The bytes of an archive, whether it is compressed or not."""
    return gzip.decompress(archive) if archive.startswith(b"\x1f\x8b") else archive


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record. A record that is cut short or malformed is an error."""
    at, view, mark = 0, memoryview(archive), VERSION.encode()
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError(f"no {mark.decode()} record at byte {at}")
        headers = _fields(archive[at:end])
        start = end + 4
        stop = start + int(headers["content-length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield headers, bytes(view[start:stop])
        at = stop + 4


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers.get("warc-type")
    size, digest, payload, fields = None, None, None, None
    declared = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if declared is not None and declared != digest:
                raise ValueError(f"{headers.get('warc-record-id')}: the payload has another digest")
        else:
            size, digest, payload = int(_fields(head).get("content-length", "0")), declared, None
    elif kind == "metadata":
        fields = list(_fields(block).items())
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"),
        headers.get("warc-refers-to-target-uri"), declared, size, digest, fields, payload,
    )


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives under ``path``; payloads are left out on request.

    An archive is read by one task, whole; ``write_archives`` bounds their size.
    """
    schema = RECORD + (", payload binary" if payload else "")
    types = [
        ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()),
        ("refers_to_uri", pa.string()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
    ] + ([("payload", pa.binary())] if payload else [])
    arrow = pa.schema(types)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                held: list[tuple] = []
                size = 0
                for headers, block in records(plain(archive.as_py())):
                    held.append(_row(headers, block)[: len(types)])
                    size += len(block) if payload else 0
                    if len(held) == 4_096 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), types)], schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), types)], schema=arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select("content").mapInArrow(parse, schema)


def transactions(read: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, response, request, metadata.

    A capture is a response or revisit record; request and metadata are those that
    name it in concurrent_to, null if none does, the one of the smallest record id if several do.
    Records that name no capture are left out. Extra columns of the records
    end up in the structs.
    """
    rest = [c for c in read.columns if c not in ("type", "concurrent_to")]
    packed = read.select(
        F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"),
        F.when(F.col("type").isin("response", "revisit"), "response").otherwise(F.col("type")).alias("role"),
        F.col("record_id").alias("_order"),
        F.struct("type", *rest).alias("record"),
    ).where("capture_id IS NOT NULL AND role IN ('response', 'request', 'metadata')")

    def of(role: str) -> Column:
        return F.min_by(F.when(F.col("role") == role, F.col("record")), F.when(F.col("role") == role, F.col("_order"))).alias(role)

    return packed.groupBy("capture_id").agg(of("response"), of("request"), of("metadata")).where("response IS NOT NULL")


def captures_with_origin(captured: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from transactions.

    A revisit refers to the smallest page of a response with the same digest.
    """
    flat = checkpointed(
        captured.select(
            F.expr("try_cast(metadata.fields['pageid'] AS bigint)").alias("page_id"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
            F.col("response.type").alias("record_type"),
        )
    )
    origins = (
        flat.where("record_type = 'response'")
        .join(flat.where("record_type = 'revisit'").select("payload_digest").distinct(), "payload_digest", "left_semi")
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("origin"))
    )
    return flat.join(broadcast_if_small(origins), "payload_digest", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", F.col("origin")).alias("refers_to"),
    )
