"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: each byte shifts it and adds the
byte's random number, so after 32 bytes nothing older is left in it.  A chunk ends
where the hash's upper bits are zero (but not before ``MIN_BYTES``, and at
``MAX_BYTES`` at last; a short rest belongs to the chunk before it), so an insertion moves the ends near it only and the chunks
after it stay what they were.  Chunks are compared by 128-bit digests.  A chunk is
a repeat if a document with a smaller id has it, or its own document has it
earlier, and repeats are removed.  ``min_run`` can ask for runs of repeats that span so
many bytes at least, so that short common phrases stay.

A document's own repeats are seen in its task; between documents there is one
row for each digest and document.  The smallest id of each digest is found by an
aggregation with partial sums before the shuffle, so a digest that a third of all
documents share costs a row for each task; the join that tells the documents
their repeats is one that Spark can split.  Repeats of a document come back as one
list, no longer than its chunks.

Defined results: a null text is the empty text (no chunk); rows with a null id
come after all others and don't remove each other's chunks, nor do rows with
equal ids; texts of any length are chunked whole; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, cut, small_batches

MIN_BYTES, MAX_BYTES = 64, 256
#: Upper bits that are zero where a chunk ends: one place in 16.
END_BITS = 4


@cache
def gear() -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 2024) & 0xFFFFFFFF for b in range(256)], dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, by doubling: the sum over the last 1, 2, 4, .. 32 bytes, each shifted by its age."""
    h = gear()[data]
    for age in (1, 2, 4, 8, 16):
        older = h[:-age] << np.uint32(age)
        h = h.copy()
        h[age:] += older
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    n = len(data)
    if not n:
        return []
    places = np.flatnonzero(rolling(np.frombuffer(data, np.uint8)) >> np.uint32(32 - END_BITS) == 0) + 1
    out, start = [], 0
    for end in [*places.tolist(), n]:
        while end - start > MAX_BYTES:
            start += MAX_BYTES
            out.append(start)
        if end - start >= MIN_BYTES or end == n and end > start:
            if end - start < MIN_BYTES and out and end - (out[-2] if len(out) > 1 else 0) <= MAX_BYTES:
                out.pop()  # a short rest belongs to the chunk before it
            out.append(end)
            start = end
    return out


def chunks(data: bytes) -> tuple[list[int], list[bytes]]:
    """The ends and the digests of the chunks of ``data``."""
    ends, start, digests, digest = chunk_ends(data), 0, [], xxhash.xxh3_128_digest
    for end in ends:
        digests.append(digest(data[start:end]))
        start = end
    return ends, digests


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, doc_id, version, at): a row for each digest of a document, with the number of the first chunk that has it."""
    for b in batches:
        digests, places, counts = [], [], []
        for text in b.column(1).to_pylist():
            first: dict[bytes, int] = {}
            for i, d in enumerate(chunks((text or "").encode("utf-8"))[1]):
                first.setdefault(d, i)
            digests += first.keys()
            places += first.values()
            counts.append(len(first))
        halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        rows = pa.array(np.repeat(np.arange(b.num_rows), counts))
        yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), b.column(0).take(rows), b.column(2).take(rows), pa.array(places, pa.int32())], names=["d1", "d2", "doc_id", "version", "at"])


def kept_parts(data: bytes, repeats: set[int], min_run: int = 0) -> tuple[int, int, int, bytes]:
    """Chunks, removed bytes, removed runs and what is left, if the chunks ``repeats`` are also in documents before this one."""
    ends, digests = chunks(data)
    starts, seen, runs = [0, *ends], {}, []
    for i, d in enumerate(digests):
        first = seen.setdefault(d, i)
        if first != i or i in repeats or first in repeats:
            if runs and runs[-1][1] == starts[i]:
                runs[-1][1] = ends[i]
            else:
                runs.append([starts[i], ends[i]])
    runs = [r for r in runs if r[1] - r[0] >= min_run]
    left, at = [], 0
    for a, z in runs:
        left.append(data[at:a])
        at = z
    left.append(data[at:])
    return len(ends), sum(z - a for a, z in runs), len(runs), b"".join(left)


def dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_text: bool = False, min_run: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed, n_spans, kept_sha256 of every row, and what is left of its text if asked for.

    What is left is decoded as UTF-8 with broken characters replaced; the digest is that of the bytes.
    """
    small_batches(df.sparkSession)
    text = F.col(f"`{text_col}`")
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", "version").mapInArrow(_emit, f"d1 bigint, d2 bigint, doc_id {kind}, version bigint, at int")
    # written first, so that the join on digests is one that Spark can split where many documents share a chunk
    first = cut(rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("d1", "d2", "first_id"))
    repeats = rows.join(first, ["d1", "d2"]).where("doc_id is null or doc_id > first_id")
    lists = repeats.groupBy("doc_id", "version").agg(F.collect_set("at").alias("ats")).select(F.col("doc_id").alias("r_id"), F.col("version").alias("r_version"), "ats")
    both = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("r_id")) & F.col("version").eqNullSafe(F.col("r_version")), "left").select("doc_id", "text", "ats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, ats in zip(*(c.to_pylist() for c in b.columns)):
                data = (text or "").encode("utf-8")
                n, removed, spans, left = kept_parts(data, set(ats or ()), min_run)
                out.append((doc_id, len(data), n, removed, spans, hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "replace")] if keep_text else [])))
            schema = pa.schema([pa.field("doc_id", b.column(0).type), *[(c, pa.int64()) for c in ("n_bytes", "n_chunks", "n_removed", "n_spans")], ("kept_sha256", pa.string()), *([("kept", pa.string())] if keep_text else [])])
            yield batch(schema, list(zip(*out)) or [[] for _ in schema])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_chunks bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept string" if keep_text else ""))
