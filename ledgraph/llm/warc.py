"""WARC archives: written from page rows, read back, and assembled into one row per capture."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, stored, table

CRLF = "\r\n"
SOFTWARE_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_TYPES = "path string, offset long, type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, http_length long, body_length long, block_fields map<string,string>, payload binary"
#: Records that a reading task holds at once, and the bytes of them.
BATCH_RECORDS, BATCH_BYTES = 1000, 16_000_000


def urn(*parts: Column) -> Column:
    """A record id in UUID form that depends on the parts only."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line ends that close it; null fields are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))) for k, v in fields]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), F.concat_ws("", *lines), F.lit("Content-Length: "), byte_length(block).cast("string"), F.lit(CRLF * 2), block)


def plan_records(pages: DataFrame, least_bytes: int = 1000, broadcast_rows: int = 500_000) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, and canonical: of equal payloads of ``least_bytes`` or more the largest page_id, else null.

    Only digests that several page_ids share are joined back, one row each. Up to ``broadcast_rows`` of them (counted
    first) are broadcast, so that payloads stay where they are; beyond that a very common payload is a skewed join key
    against a single row, which adaptive execution splits.
    """
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", byte_length(F.col("payload"))).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    shared = p.filter(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("canonical"), F.min("page_id").alias("least"))
    shared = stored(shared.filter(F.col("canonical") != F.col("least")).select("digest", "canonical"), "warc-shared")
    return p.join(F.broadcast(shared) if shared.count() <= broadcast_rows else shared, "digest", "left")


def archive_lines(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """value: the request, response or revisit, and metadata record of every page, in that order, without the line ends that close the last.

    Rows with an equal payload of ``least_bytes`` or more become revisits of the one with the largest page_id (rows that
    repeat that id are responses too). The payload is the html in UTF-8; null is empty; a null url is empty, a null
    page_id has no page-id line. Request and metadata name the capture through WARC-Concurrent-To; a revisit refers to
    the record id of its response, which depends on page_id and payload alone.
    """
    p = plan_records(pages, least_bytes)
    named = lambda i: F.coalesce(F.concat(F.lit("id "), i.cast("string")), F.lit("none"))  # noqa: E731  no id is another than an empty one
    page = named(F.col("page_id"))
    revisit = F.col("canonical").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("canonical")))
    response_id = lambda i: urn(F.lit("response"), i, F.col("digest"))
    own = F.when(revisit, urn(F.lit("revisit"), page, F.col("url"), F.col("digest"))).otherwise(response_id(page))
    # Header values hold no line ends.
    uri = F.regexp_replace(F.col("url"), r"[\r\n]", "%0A")
    date, digest = ("WARC-Date", F.lit(SOFTWARE_DATE)), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    captured = record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", own),
            date,
            ("WARC-Target-URI", uri),
            digest,
            ("WARC-Refers-To", F.when(revisit, response_id(named(F.col("canonical"))))),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, head).otherwise(F.concat(head, F.col("payload"))),
    )
    request = record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", urn(F.lit("request"), page, F.col("url"), F.col("digest"))), date, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    # Line ends and percent signs of a text id are escaped, as a field is a line.
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("page_id").cast("string"), "%", "%25"), "\r", "%0D"), "\n", "%0A")
    notes = F.coalesce(F.concat(F.lit("page-id: "), escaped, F.lit(CRLF)), F.lit(""))
    metadata = record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", urn(F.lit("metadata"), page, F.col("url"), F.col("digest"))), date, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], notes)
    return p.select(F.concat(request, F.lit(CRLF * 2), captured, F.lit(CRLF * 2), metadata).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, pages_per_file: int = 2000) -> None:
    """Writes the records of every page (``archive_lines``) under ``path``, gzipped by file.

    Spark's text writer puts the closing line ends between records, so each part file is a gzipped WARC file of at most
    ``pages_per_file`` pages, committed as any Spark output. A page is one row of the writer, so a file's size is that
    of its pages; ``read_archives`` doesn't hold a file, only a batch of its records.
    """
    archive_lines(pages, least_bytes).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", pages_per_file).option("compression", "gzip").text(path)


def inflated(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file (of one member or, as many WARC files, of one a record), or of a plain one, bit by bit."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[i : i + step] for i in range(0, len(raw), step))
        return
    at, inflate = 0, zlib.decompressobj(31)
    while True:
        data = inflate.unconsumed_tail or raw[at : (at := at + step)]
        if inflate.eof:
            data = inflate.unused_data or data
            while not data.strip(b"\0") and at < len(raw):
                data = raw[at : (at := at + step)]
            if not data.strip(b"\0"):
                return
            inflate = zlib.decompressobj(31)
        elif not data:
            raise ValueError("a gzip member is cut short")
        yield inflate.decompress(data, step)


def parse_archive(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset (in the unpacked file), header fields (names in lower case) and block of each record of a WARC file, gzipped or not.

    One record is unpacked at a time. Raises ValueError where a record is cut short or doesn't begin with a version line.
    """
    chunks, held, at = inflated(raw), b"", 0

    def fill(n: int) -> bool:
        nonlocal held
        parts, size = [held], len(held)
        while size < n and (more := next(chunks, None)) is not None:
            parts.append(more)
            size += len(more)
        held = b"".join(parts)
        return size >= n

    while True:
        while fill(2) and held[:2] == b"\r\n":
            held, at = held[2:], at + 2
        if not held:
            return
        while (end := held.find(b"\r\n\r\n")) < 0 and fill(len(held) + 1):
            pass
        lines = held[: max(end, 0)].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = end + 4 + int(fields["content-length"])
        if not fill(size):
            raise ValueError(f"record at byte {at} is cut short")
        yield at, fields, held[end + 4 : size]
        held, at = held[size:], at + size


def _record_row(name: str, at: int, f: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    http, body, notes, kind = None, None, {}, f.get("warc-type")
    if kind in ("response", "revisit"):
        top, _, body = block.partition(b"\r\n\r\n")
        http = re.search(rb"(?im)^content-length:\s*(\d+)", top)
        http = int(http[1]) if http else len(body)
        if kind == "response" and f.get("warc-payload-digest", "").removeprefix("sha1:") != hashlib.sha1(body).hexdigest():
            raise ValueError(f"{name}, byte {at}: the payload doesn't have its digest")
    elif kind == "metadata":
        notes = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(CRLF) if ": " in x)
    return (name, at, kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-payload-digest"), http, None if body is None else len(body), list(notes.items()), body if with_payload else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the WARC files under ``path``.

    A task holds a packed file and a batch of its records (BATCH_RECORDS, about BATCH_BYTES), not the unpacked file.
    http_length is what the HTTP header says, body_length what the block holds; both null for other records.
    """
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["path", "offset", "type", "record_id", "concurrent_to", "refers_to", "target_uri", "payload_digest", "http_length", "body_length", "block_fields", "payload"]

    def rows(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out, held = [], 0
                for at, f, block in parse_archive(raw.as_py()):
                    out.append(_record_row(name, at, f, block, with_payload))
                    held += len(block) if with_payload else 0
                    if len(out) >= BATCH_RECORDS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    # One file a batch, so that a task holds one.
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, RECORD_TYPES)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit record: capture, request, metadata (structs; null where there is none).

    Requests and metadata are joined through WARC-Concurrent-To. Where several name the same capture, the first by
    file and offset is taken; repeated capture records each give a row. Records that name no known capture are left out.
    """
    whole = F.struct(*[F.col(c) for c in records.columns])

    def named(kind: str) -> DataFrame:
        own = records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return own.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(F.struct("record_id", "target_uri", F.map_entries("block_fields").alias("fields")), F.struct("path", "offset")).alias(kind))

    captures = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), whole.alias("capture"))
    return captures.join(named("request"), "capture_id", "left").join(named("metadata"), "capture_id", "left")


def page_rows(captures: DataFrame, id_type: str, broadcast_rows: int = 500_000) -> DataFrame:
    """page_id (as ``id_type``), payload_bytes, payload_digest, record_type, refers_to (the response's page_id) of assembled captures.

    A response's payload_bytes are those of its body, a revisit's those that its header tells. Only revisits are joined
    with the responses they name, one row each of these, broadcast up to ``broadcast_rows`` (counted); so responses
    don't travel, and a payload that very many pages share is a skewed key against one row, which adaptive execution splits.
    """
    note = F.map_from_entries("metadata.fields")["page-id"]
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(note, "%0A", "\n"), "%0D", "\r"), "%25", "%")
    rows = captures.select(
        text.cast(id_type).alias("page_id"),
        F.when(F.col("capture.type") == "response", F.col("capture.body_length")).otherwise(F.col("capture.http_length")).alias("payload_bytes"),
        F.regexp_replace("capture.payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").alias("to"),
        F.col("capture_id"),
    )
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses, revisits = rows.filter("record_type = 'response'"), rows.filter("record_type = 'revisit'")
    wanted = stored(revisits.filter("to IS NOT NULL").select(F.col("to").alias("capture_id")).distinct(), "warc-wanted")
    few = wanted.count() <= broadcast_rows
    named = responses.join(F.broadcast(wanted) if few else wanted, "capture_id", "left_semi").groupBy(F.col("capture_id").alias("to")).agg(F.max("page_id").alias("refers_to"))
    named = stored(named, "warc-named")
    resolved = revisits.join(F.broadcast(named) if few else named, "to", "left").select(*shown, "refers_to")
    return responses.select(*shown, F.lit(None).cast(id_type).alias("refers_to")).unionByName(resolved)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, the archives read back, assembled, and a row per page made of them.

    Null html is an empty payload, a null page_id stays null, repeated rows give a row each; page_id keeps its type.
    """
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    captures = stored(assemble(stored(read_archives(spark, path, with_payload=False), "warc-records")), "warc-captures")
    return page_rows(captures, pages.schema["page_id"].dataType.simpleString())


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest AS d, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN m ON d = payload_digest
"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": SQL}
