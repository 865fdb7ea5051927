"""WARC archives: a writer of whole-file gzip streams and the normaliser that gives every record its own member."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import written

#: Raw bytes after which a task begins another archive; a larger page has an archive of its own.
ARCHIVE_BYTES = 8 << 20
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
LEVEL = 3
_READ = 1 << 16


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload and names the record that holds it."""
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "") or f"urn:page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
             f"X-Payload-Length: {len(payload)}", "Content-Type: text/html"]
    body = payload
    if refers_to is not None:
        body = b""
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(content) of gzip files, each one stream over many records."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    rows = rows.join(large, "digest", "left").withColumn("refers_to", F.when(
        (F.octet_length("payload") >= REVISIT_BYTES) & ~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, parts, size = None, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, stream.flush()])], pa.binary())], ["content"])

        for batch in batches:
            for k in range(len(batch)):
                i, url, body, digest, refers_to = (batch.column(c)[k].as_py() for c in range(5))
                if stream is not None and size + len(body) > ARCHIVE_BYTES:
                    yield closed()
                    stream = None
                if stream is None:
                    stream, parts, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0
                parts.append(stream.compress(record(i, url, body, digest, refers_to)))
                size += len(body)
        if stream is not None:
            yield closed()

    return rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "content binary")


def inflated(content: bytes) -> Iterator[bytes]:
    """The records of a gzip file, whatever its members, in one pass with little memory."""
    held, at = bytearray(), 0
    stream = zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, stream
        while at < len(content):
            if stream.eof:
                stream = zlib.decompressobj(31)
            piece = content[at:at + _READ]
            held.extend(stream.decompress(piece))
            at += len(piece) - len(stream.unused_data)
            if held:
                return True
            if not piece:
                break
        return False

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            was = len(held)
            if not more():
                if bytes(held).strip():
                    raise ValueError("an archive ends inside a record")
                return
            end = held.find(b"\r\n\r\n", max(0, was - 3))
        fields = headers(bytes(held[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield bytes(held[:size])
        del held[:size]


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record begins with {lines[0][:40]!r}")
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}


def _page(urn: str | None) -> int | None:
    name = urn[len("<urn:page:"):-1] if urn else "None"
    return None if name == "None" else int(name)


INDEX = ("member_offset long, member_length long, page_id long, record_type string, url string, payload_bytes long, "
         "payload_digest string, refers_to long")


def normalise(archives: DataFrame) -> DataFrame:
    """(content, index) for archives (content): every record in a gzip member of its own, and where each one lies.

    The input is inflated once as a stream, whether it is one member or many, and a record is rewritten as soon as it
    is complete. The payload of a response is hashed again and must match its digest.
    """
    fields = ["member_offset", "member_length", "page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        kind = pa.list_(pa.struct(list(zip(fields, kinds, strict=True))))
        for batch in batches:
            for content in batch.column(0):
                out, index, offset = [], [], 0
                for raw in inflated(content.as_py()):
                    end = raw.index(b"\r\n\r\n")
                    f = headers(raw[:end])
                    digest, body = f["warc-payload-digest"].removeprefix("sha1:"), raw[end + 4:-4]
                    if f["warc-type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    index.append((offset, len(member), _page(f["warc-record-id"]), f["warc-type"], f["warc-target-uri"],
                                  int(f["x-payload-length"]), digest, _page(f.get("warc-refers-to"))))
                    out.append(member)
                    offset += len(member)
                rows = [dict(zip(fields, x, strict=True)) for x in index]
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary()), pa.array([rows], kind)], ["content", "index"])

    return archives.mapInArrow(run, f"content binary, index array<struct<{INDEX.replace(' ', ':').replace(',:', ', ')}>>")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page, from archives that are written, read back, normalised and indexed: page_id, payload_bytes,
    payload_digest, record_type, refers_to, and the place of its member.

    Null html is an empty payload; a null URL is named after the page; white space and control characters in a URL
    are escaped. Equal payloads of at least 1000 bytes are stored with the largest page id; rows that repeat this id
    are responses each. Rows without an id are revisits of a page with an id, or responses. A very long page is one
    record, held whole in its task; an empty table gives no rows.
    """
    archives = written(write_archives(pages, id_col, url_col, html_col))
    normal = written(normalise(archives))
    return normal.select(F.explode("index").alias("r")).select(
        F.col("r.page_id").alias(id_col), "r.payload_bytes", "r.payload_digest", "r.record_type", "r.refers_to",
        "r.member_offset", "r.member_length")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON k.html = p.html
"""
