"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

``write`` puts each row into a gzip member of its own in archives below a shared
folder.  Of the rows with equal payloads the one with the largest id becomes a
``response`` record, the others ``revisit`` records that refer to it; payloads of
fewer than ``min_bytes`` bytes are always written in full.  Archives are named
after the task attempt and listed by the manifest that is returned, so a repeated
task never mixes with what a lost one left behind.

``read`` walks each archive member by member (or record by record, where it is
not compressed).  A record counts if it parses, ends where its length says and
matches its digests.  After a failed check the reader searches for the next
member or version line that starts a record which does count, goes on from
there, and logs the bytes between as a gap.  It holds one record at a time.

Both open archives with Arrow's file systems, so the folder may be local or in a
store that these know (file, hdfs, s3, gs); on a cluster it must be shared.

Defined results: a null html is the empty payload; a null url has no target
line; rows with a null id never serve as response for rows that have one, and
without any id among equal payloads each row is a response (so are repeated rows
with the largest id); no rows give no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, cut, ensure_checkpoint_dir, small_batches, texts_of

#: A new archive is begun after so many bytes.
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 18
#: So much of a record is read first; a longer header is read on to its end.
HEADER_BYTES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: A record may start wherever this is found: damage needn't end with a line.
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, as it stands uncompressed: a response, or a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", "%0A", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """The data as one gzip member."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_roles(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the page whose payload this row's equals, or null for a response."""
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    keepers = rows.select("sha1", "page_id").groupBy("sha1").agg(F.max("page_id").alias("keeper"))
    refers = (F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.join(keepers, "sha1").select("page_id", "url", "html", F.when(refers, F.col("keeper")).alias("refers_to"))


def write(df: DataFrame, folder: str | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """Write the archives; returns their manifest: path, records, bytes."""
    small_batches(df.sparkSession)
    top = folder or f"{ensure_checkpoint_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(top)
        task, out, done = TaskContext.get(), None, 0
        records = size = 0
        for b in batches:
            for page_id, url, html, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), b.column(3).to_pylist()):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{done:04d}.warc.gz"
                    out, records, size = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = member(record(page_id, url, html.encode("utf-8"), refers_to))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield batch(schema, [[f"{top}/{name}"], [records], [size]])
                    out, done = None, done + 1
        if out is not None:
            out.close()
            yield batch(schema, [[f"{top}/{name}"], [records], [size]])

    return cut(with_roles(df, id_col, html_col, url_col, min_bytes).mapInArrow(run, "path string, records bigint, bytes bigint"))


@dataclass
class Found:
    """A record that counts, or (with no headers) a gap, and where it stands in its archive."""

    start: int
    end: int
    headers: dict[str, str] | None = None
    block: bytes = b""
    reason: str = ""


class Damaged(Exception):
    pass


class Archive:
    """Random access to an archive of any length, read in pieces."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(min(n, self.size - start))

    def find(self, start: int) -> int:
        """Where the next member or version line may start, from ``start`` on; the archive's end if nowhere."""
        while start < self.size:
            m = _START.search(self.at(start, READ_BYTES + 16))
            if m and m.start() < READ_BYTES:
                return start + m.start()
            start += READ_BYTES
        return self.size

    def inflate(self, start: int) -> tuple[bytes, int]:
        """The content of the gzip member at ``start``, and where it ends."""
        z, out, at = zlib.decompressobj(31), [], start
        while not z.eof:
            data = self.at(at, READ_BYTES)
            if not data:
                raise Damaged("member is cut off")
            try:
                out.append(z.decompress(data))
            except zlib.error as e:
                raise Damaged(f"member: {e}") from e
            at += len(data)
        return b"".join(out), at - len(z.unused_data)

    def header(self, start: int, head: bytes) -> bytes:
        """The piece ``head`` at ``start``, read on until the blank line that ends a header."""
        out = bytearray(head)
        while out.startswith(VERSION) and out.find(b"\r\n\r\n", max(0, len(out) - READ_BYTES - 3)) < 0 and (more := self.at(start + len(out), READ_BYTES)):
            out += more
        return bytes(out)

    def record(self, start: int) -> Found:
        """The record at ``start``, checked."""
        head = self.at(start, HEADER_BYTES)
        if head.startswith(GZIP_MAGIC):
            data, end = self.inflate(start)
            headers, at, n = parse_header(data)
            if len(data) != at + n + 4:
                raise Damaged("length differs from the member's")
            block, tail = data[at : at + n], data[at + n :]
        else:
            headers, at, n = parse_header(self.header(start, head))
            block, tail, end = self.at(start + at, n), self.at(start + at + n, 4), start + at + n + 4
        if len(block) != n or tail != b"\r\n\r\n":
            raise Damaged("record doesn't end where its length says")
        if (said := headers.get("warc-block-digest")) and said != "sha1:" + digest(block):
            raise Damaged("block digest differs")
        if headers["warc-type"] == "response" and (said := headers.get("warc-payload-digest")) and said != "sha1:" + digest(payload_of(block)):
            raise Damaged("payload digest differs")
        return Found(start, end, headers, block)

    def salvage(self) -> Iterator[Found]:
        """Every record that counts, in order, and a gap for the bytes between."""
        at, gap, reason = 0, None, ""
        while at < self.size:
            try:
                found = self.record(at)
            except Damaged as e:
                gap, reason = (at, str(e)) if gap is None else (gap, reason)
                at = self.find(at + 1)
                continue
            if gap is not None:
                yield Found(gap, at, reason=reason)
                gap = None
            yield found
            at = found.end
        if gap is not None:
            yield Found(gap, self.size, reason=reason)


def parse_header(data: bytes) -> tuple[dict[str, str], int, int]:
    """The named fields, where the block starts, and its length."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION) or end < 0:
        raise Damaged("no version line or header")
    try:
        lines = re.sub(r"\r\n[ \t]+", " ", data[:end].decode("utf-8")).split("\r\n")[1:]  # a line that begins with a blank goes on with the one before
        headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        n = int(headers["content-length"])
    except (ValueError, KeyError) as e:
        raise Damaged("bad header") from e
    if "warc-type" not in headers or n < 0:
        raise Damaged("bad header")
    return headers, end + 4, n


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    return block.partition(b"\r\n\r\n")[2]


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


READ_SCHEMA = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
READ_DDL = "path string, start bigint, end bigint, kind string, reason string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _row(path: str, x: Found, payloads: bool) -> tuple:
    if x.headers is None:
        return (path, x.start, x.end, "gap", x.reason, *[None] * 7)
    kind, payload, h = x.headers["warc-type"], payload_of(x.block), x.headers
    if kind == "response":
        length, sha1 = len(payload), digest(payload)
    else:
        m = re.search(rb"(?i)\r\nContent-Length: *(\d+)", x.block)
        length, sha1 = int(m[1]) if m else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return path, x.start, x.end, "record", None, _page(h.get("warc-record-id")), h.get("warc-target-uri"), kind, _page(h.get("warc-refers-to")), length, sha1, payload if payloads and kind == "response" else None


def read(paths: DataFrame, payloads: bool = True, rows: int = 128) -> DataFrame:
    """A row for each record and for each gap of the archives in the column ``path`` (see ``READ_DDL``)."""
    spark = paths.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                held: list[tuple] = []
                with store.open_input_file(name) as f:
                    for x in Archive(f).salvage():
                        held.append(_row(path, x, payloads))
                        if len(held) == rows:
                            yield batch(READ_SCHEMA, list(zip(*held)))
                            held = []
                if held:
                    yield batch(READ_SCHEMA, list(zip(*held)))

    return paths.select("path").mapInArrow(run, READ_DDL)
