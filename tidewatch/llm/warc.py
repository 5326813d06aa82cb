"""WARC archives of pages, and a reader that salvages damaged ones.

The writer makes one record per page: a response, or a revisit of an earlier record with the same
payload, which then carries the HTTP head only. With ``compress`` every record is a gzip member of its
own, with an empty member after it; else a plain record. Spark's text writer stores the bytes, the
separator being the line end, so archives can lie in any store Spark reaches.

The reader checks every record: the member's CRC, the version line, the head, the length, the block
digest and a response's payload digest. Where a check fails it searches for the next place at which a valid
member or record begins, reports the bytes in between as a gap with the reason, and goes on from there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.tables import small_batches
from tidewatch.plans.staging import staged

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_END = b"\r\n\r\n"
_MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_CHUNK = 1 << 14


@dataclass(frozen=True)
class WarcParams:
    least_bytes: int = 0  # smaller payloads are never revisits
    compress: bool = True
    date: str = "2024-01-01T00:00:00Z"
    records_per_file: int = 1000


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record without the blank lines after it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {uri}")
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + _END + block


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Write ``pages`` (``page_id, url, html``; other columns are ignored) to archives below ``path``.

    The payload is the html in UTF-8, a null one empty. Of rows with equal payloads of at least
    ``least_bytes``, those with the largest page_id are responses, all others revisits of it; a null page_id
    counts as smaller than any. An empty table gives no record.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("_sha"), F.octet_length(html).alias("_size"))
    shared = rows.where(F.col("_size") >= params.least_bytes).groupBy("_sha", "_size")
    shared = shared.agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # Written, so that its size is known when the join with the pages is planned.
    shared = staged(shared.select("_sha", "_size", "first"), "payloads")
    rows = rows.join(shared, ["_sha", "_size"], "left").select(
        "page_id", "url", "html", F.col("first").alias("refers_to"),
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
    )
    compress, date = params.compress, params.date

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                payload = row["html"].encode("utf-8", "surrogatepass")
                record = record_bytes(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"], date)
                made.append(_gzip(record + _END) if compress else record)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    separator = EMPTY_MEMBER if compress else _END
    writer = records.write.option("lineSep", separator.decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", params.records_per_file).text(path)


class Damaged(ValueError):
    """A place at which no valid record begins."""


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at``, and its end."""
    unpacker, parts, fed = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and fed < len(data):
            parts.append(unpacker.decompress(data[fed : fed + _CHUNK]))
            fed = min(fed + _CHUNK, len(data))
    except zlib.error as error:
        raise Damaged("bad gzip member") from error
    if not unpacker.eof:
        raise Damaged("truncated gzip member")
    return b"".join(parts), fed - len(unpacker.unused_data)


def _headers(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and the end of its closing blank lines; raises ``Damaged``."""
    line = data[at : at + 10]
    if line not in (b"WARC/1.1\r\n", b"WARC/1.0\r\n"):
        raise Damaged("no version line")
    body = data.find(_END, at)
    if body < 0:
        raise Damaged("truncated head")
    head = _headers(bytes(data[at + 10 : body]))
    size = head.get("content-length", "")
    if not size.isdecimal() or "warc-type" not in head:
        raise Damaged("bad header")
    body += 4
    end = body + int(size)
    if data[end : end + 4] != _END:
        raise Damaged("truncated block" if end + 4 > len(data) else "wrong length")
    block = bytes(data[body:end])
    wanted = head.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:].upper() != sha1_base32(block):
        raise Damaged("wrong block digest")
    payload, length = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(_END)
        length = len(payload)
        if head["warc-type"] == "revisit":
            declared = _headers(top.partition(b"\r\n")[2]).get("content-length", "")
            length = int(declared) if declared.isdecimal() else None
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if digest and head["warc-type"] == "response" and digest.upper() != sha1_base32(payload):
        raise Damaged("wrong payload digest")
    return {
        "record_type": head["warc-type"],
        "record_id": head.get("warc-record-id"),
        "target_uri": head.get("warc-target-uri"),
        "refers_to": head.get("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": length,
        "payload": payload,
    }, end + 4


def _record_at(data: bytes, view: memoryview, at: int) -> tuple[dict | None, int]:
    """The record or the empty member (None) at ``at``, and its end."""
    if data[at : at + 3] == _MAGIC:
        content, end = _member(view, at)
        if not content:
            return None, end
        record, used = parse_record(content, 0)
        if used != len(content):
            raise Damaged("bytes after the record")
        return record, end
    return parse_record(data, at)


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive in order, each with ``offset, length, kind, reason``."""
    view, at = memoryview(data), 0
    while at < len(data):
        start, reason = at, None
        while True:
            try:
                record, end = _record_at(data, view, at)
                break
            except Damaged as error:
                reason = reason or str(error)
                following = _START.search(data, at + 1)
                if following is None:
                    at, record, end = len(data), None, len(data)
                    break
                at = following.start()
        if at > start:
            yield {"offset": start, "length": at - start, "kind": "gap", "reason": reason}
        if record is not None:
            yield record | {"offset": at, "length": end - at, "kind": "record", "reason": None}
        at = end


SCHEMA = (
    "archive string, offset long, length long, kind string, reason string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (``kind``) of all archives below ``path``; see ``SCHEMA``.

    A task holds one archive at a time. Without ``payloads`` the column is null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows: list[dict] = []
                size = 0
                for found in salvage(content.as_py()):
                    if not payloads:
                        found.pop("payload", None)
                    rows.append({name: found.get(name) for name in schema.names} | {"archive": path.as_py()})
                    size += len(found.get("payload") or b"")
                    if len(rows) == 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in SCHEMA.split(", "))])
    small_batches(spark, rows=2)  # a row is a whole archive
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def page_table(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the archives' page records."""
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    long = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return records.where("kind = 'record'").select(
        long("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", long("refers_to").alias("refers_to")
    )
