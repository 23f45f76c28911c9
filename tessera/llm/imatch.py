"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon is made of the terms (lower-cased words between white space) whose
inverse document frequency ln(N/df), counted over all documents, lies between
``IDF_MIN`` and ``IDF_MAX``.  Each random subset of the lexicon gives one hash of
a document: of its sorted distinct terms in that subset.  The fingerprint is the
sequence of these hashes.  There are ``SCALES`` times ``SUBSETS`` subsets; one of
the first scale holds a 64th of the lexicon, one of each next scale a quarter of
that, so that for short and long documents alike some scale has few terms of the
document in each subset.  Two fingerprints are as alike as the share of equal
hashes among the subsets in which either has a term, on the sparsest scale that
has ``ENOUGH`` such subsets (the densest scale, if none has).

A term of the lexicon is in at least N*exp(-IDF_MAX) documents, so the lexicon
has at most (mean number of distinct terms of a document)*exp(IDF_MAX) terms,
however many documents there are; that bound makes broadcasting it safe.

Defined results: a null text is the empty text; a document without any term of
the lexicon gets the hash of all its distinct terms, which is like equal ones
only; rows with a null id come last in the order of documents, rows with equal
ids are ordered by their packed text; a lone document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, shuffle_parts, small_batches, texts_of

IDF_MIN = 2.0
IDF_MAX = 7.5
SCALES = 4
SUBSETS = 64
ENOUGH = 12
#: A hash in the fingerprint is two of these, 12 bits; none is two dots.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
#: Terms that a task counts before it hands the counts on.
FLUSH_TERMS = 200_000


def terms_of(text: str) -> set[str]:
    return set(text.lower().split())


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("term", pa.string()), ("df", pa.int64())])
    found: Counter = Counter()
    for b in batches:
        for text in texts_of(b.column(0)):
            found.update(terms_of(text))
            if len(found) >= FLUSH_TERMS:
                yield batch(schema, [list(found), list(found.values())])
                found = Counter()
    if found:
        yield batch(schema, [list(found), list(found.values())])


def document_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """term, df: in how many documents each term is, counted over all of them."""
    small_batches(df.sparkSession)
    return df.select(F.col(text_col).alias("text")).mapInArrow(_document_frequency, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(df: DataFrame, text_col: str = "text", idf_min: float = IDF_MIN, idf_max: float = IDF_MAX) -> dict[str, tuple[int, ...]]:
    """The terms in the band, each with the subsets that it is in."""
    total = df.count()
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    terms = document_frequencies(df, text_col).where(idf.between(idf_min, idf_max)).select("term")
    return {r.term: subsets_of(r.term) for r in terms.toLocalIterator()}


def subsets_of(term: str) -> tuple[int, ...]:
    """The subsets that the term is in: one of the first scale, and of each next one with a quarter of the chance."""
    h = xxhash.xxh64_intdigest(term, 7)
    chance, slots = h >> 40, h & (1 << 40) - 1
    return tuple(SUBSETS * s + (slots >> 6 * s) % SUBSETS for s in range(SCALES) if chance % 4**s == 0)


def fingerprint(text: str, lex: dict[str, tuple[int, ...]]) -> str:
    """The hashes of the document's terms in each subset, two digits each; two dots where there is none."""
    terms = terms_of(text)
    kept = sorted(terms & lex.keys())
    if not kept:
        return "all:" + xxhash.xxh64_hexdigest("\n".join(sorted(terms)))
    parts: dict[int, list[str]] = {}
    for t in kept:
        for i in lex[t]:
            parts.setdefault(i, []).append(t)
    out = [".."] * (SCALES * SUBSETS)
    for i, p in parts.items():
        h = xxhash.xxh64_intdigest("\n".join(p))
        out[i] = DIGITS[h & 63] + DIGITS[h >> 6 & 63]
    return "".join(out)


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1 (see the module's description)."""
    if a == b:
        return 1.0
    if a[:4] == "all:" or b[:4] == "all:":
        return 0.0
    share, width = 0.0, 2 * SUBSETS
    for at in range((SCALES - 1) * width, -1, -width):
        pairs = [(a[i : i + 2], b[i : i + 2]) for i in range(at, at + width, 2)]
        some = sum([x != ".." or y != ".." for x, y in pairs])
        share = sum([x == y != ".." for x, y in pairs]) / some if some else 0.0
        if some >= ENOUGH:
            break
    return share


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon(df, text_col))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            schema = pa.schema([pa.field("doc_id", b.column(0).type), ("n_chars", pa.int64()), ("fingerprint", pa.string())])
            yield batch(schema, [b.column(0), [len(t) for t in texts], [fingerprint(t, shared.value) for t in texts]])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars bigint, fingerprint string")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the one shuffle that carries them."""
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t.encode("utf-8")) for t in texts_of(b.column(1))], pa.binary())], names=["doc_id", "text"])


def _with_next(df: DataFrame) -> DataFrame:
    """Rows (doc_id, packed text) dealt into ranges of ids, each in descending order, and ended by the row that follows it.

    Only the ranges' limits and largest ids go through the driver: a few for each partition.
    """
    spark = df.sparkSession
    lowest = F.lit(-(2**63)).cast("long")
    keyed = lambda d: d.withColumns({"key": F.coalesce("doc_id", lowest), "at": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300))})
    rows = keyed(df.select("doc_id"))
    parts = shuffle_parts(spark)
    marks = sorted(set(rows.select("at").approxQuantile("at", [i / (4 * parts) for i in range(1, 4 * parts)], 0.0005))) if parts else []
    splits = [-float("inf"), *([m for m in marks if m > -1e300] or [0.0]), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="at", outputCol="bucket")
    largest = sorted((r.bucket, r.key) for r in bucketed.transform(rows.select("key", "at")).select("bucket", "key").groupBy("bucket").agg(F.max("key").alias("key")).collect())
    kind = df.schema["doc_id"].dataType.simpleString()
    dealt = bucketed.transform(keyed(df.select("doc_id", "text").mapInArrow(_packed, f"doc_id {kind}, text binary")))
    if not largest:
        return dealt.select("doc_id", "text", "bucket", F.lit(False).alias("tail"))
    tails = [(key, largest[(i + 1) % len(largest)][0]) for i, (_, key) in enumerate(largest)]
    extra = spark.createDataFrame(tails, "key long, tail_of double")
    both = dealt.join(F.broadcast(extra), "key", "left").withColumn(
        "put", F.explode(F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(False).alias("tail")), F.when(F.col("tail_of").isNotNull(), F.struct(F.col("tail_of").alias("bucket"), F.lit(True).alias("tail"))))))
    )
    flat = both.select("doc_id", "text", "key", "put.bucket", "put.tail")
    return flat.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), "text").select("doc_id", "text", "bucket", "tail")


def compare_with_edit(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every row's text and edited text, and how alike they and the next row's are (see the module)."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon(df, text_col))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, held, done, z = shared.value, None, None, zstandard.ZstdDecompressor()
        for b in batches:
            schema = pa.schema([pa.field("doc_id", b.column(0).type), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])
            out: list[tuple] = []
            for doc_id, packed, bucket, tail in zip(*(c.to_pylist() for c in b.columns)):
                if tail and bucket == done:
                    continue
                text = z.decompress(packed).decode("utf-8")
                fp = fingerprint(text, lex)
                if held is not None:
                    edited = edited_text(held[1], text)
                    edited_fp = fingerprint(edited, lex)
                    out.append((held[0], len(held[1]), hashlib.sha256(edited.encode("utf-8")).hexdigest(), held[2], edited_fp, likeness(held[2], edited_fp), likeness(held[2], fp)))
                held, done = (None, bucket) if tail else ((doc_id, text, fp), done)
            if out:
                yield batch(schema, list(zip(*out)))

    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(docs).mapInArrow(run, schema)
