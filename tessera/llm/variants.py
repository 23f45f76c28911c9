"""Spelling variants: words that differ by one edit, found by their three rarest bigrams.

An edit changes at most two of a word's bigrams, so of its three rarest ones (by how
often a bigram comes in all words, then by the bigram, then by place) one at least
is kept and is among the three rarest of the other word too.  The position limit:
what a kept bigram stands before or behind of is unchanged, so it has the same place
counted from the start (the edit comes after it) or from the end (the edit comes
before it), and all text on that side is equal.  The key of a bigram is therefore
its word without the part that the edit lies in.  That part is halved ``HALVINGS``
times: with one edit between two parts, either their first or their last halves (of
the shorter one's length) are equal.  Words that meet by a key are verified by their
edit distance.  Of a word's keys those that its bigrams have in common are one.

What is sent to all tasks are the counts of bigrams, of which the 90 letters that a
word can hold allow 8,100.  A form has ten times its word's occurrences or more, so a
chain of forms has as many steps as the largest count has digits, at most.

Defined results: a null text has no words; a null id counts as the empty text before
the colon; repeated rows count as often as they come; a word without near words has
n_near 0 and is its own root; no rows give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, cut, small_batches, texts_of

SHORTEST, LEAST = 7, 2
#: One in so many words of a document is written with a letter left out.
SLIP = 31
#: Times as often as a word its form must come.
FORM_TIMES = 10
RAREST = 3
HALVINGS = 3
#: Distinct words that a task counts before it hands the counts on.
FLUSH_WORDS = 400_000
#: Letters in Latin-1, where each is one byte: A to Z in lower case, all else but a to z and U+00C0 to U+00FF as a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The lower-cased runs of letters of a text, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def slipped(run: bytes, start: int) -> bytes:
    """The word that a run stands for in a document; ``start`` is the crc32 of the document's id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode("utf-8"), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, found = pa.schema([("word", pa.string()), ("n", pa.int64())]), Counter()
    flush = lambda: batch(schema, [[w.decode("latin-1") for w in found], list(found.values())])
    for b in batches:
        for doc_id, text in zip(texts_of(b.column(0)), texts_of(b.column(1))):
            start = zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(runs(text)).items():
                if len(run) >= SHORTEST and len(word := slipped(run, start)) >= SHORTEST:
                    found[word] += n
        if len(found) > FLUSH_WORDS:
            yield flush()
            found.clear()
    if found:
        yield flush()


def word_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word, n of every word of ``SHORTEST`` code points or more that comes at least twice."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for b in batches:
        for word in b.column(0).to_pylist():
            found.update(map(str.__add__, word, word[1:]))
    yield batch(pa.schema([("bigram", pa.string()), ("n", pa.int64())]), [list(found), list(found.values())])


def bigram_counts(words: DataFrame) -> dict[bytes, int]:
    """How often each bigram comes in the words; 8,100 of them at most, the two letters of each in Latin-1."""
    counted = words.select("word").mapInArrow(_bigrams, "bigram string, n bigint").groupBy("bigram").agg(F.sum("n").alias("n"))
    return {r.bigram.encode("latin-1"): r.n for r in counted.collect()}


def _halved(head: int, tail: int, rest: int, times: int) -> Iterator[tuple[int, int]]:
    """Lengths of equal heads and tails, one of which two words have that share ``head`` and ``tail`` and have one edit in the ``rest`` between."""
    if not times or rest < 2:
        yield head, tail
        return
    half = rest // 2
    yield from _halved(head + half, tail, rest - half, times - 1)
    yield from _halved(head, tail + half, rest - half, times - 1)


@lru_cache(100_000)
def spans(length: int, at: int) -> frozenset[tuple[int, int, int]]:
    """(length of the shorter word, head, tail) of every key of a bigram at ``at`` in a word of ``length``."""
    found = set()
    for shorter in (length, length - 1):
        for head, tail in ((at + 2, 0), (0, length - at)):
            if (rest := shorter - head - tail) >= 0:
                found.update((shorter, *x) for x in _halved(head, tail, rest, HALVINGS))
    return frozenset(found)


def rarest(word: bytes, counts: dict[bytes, int]) -> list[int]:
    """Places of a word's rarest bigrams."""
    return [i for _, _, i in sorted((counts[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))[:RAREST]]


def keys_of(word: bytes, counts: dict[bytes, int]) -> list[int]:
    """The signed 64-bit keys of a word."""
    n, found = len(word), frozenset().union(*[spans(len(word), i) for i in rarest(word, counts)])
    digest = xxhash.xxh64_intdigest
    return [k - (1 << 64) if (k := digest(b"%b %b" % (word[:head], word[n - tail :]), shorter)) >> 63 else k for shorter, head, tail in found]


def _keyed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            keys = [keys_of(w.encode("latin-1"), counts) for w in b.column(0).to_pylist()]
            repeat = pa.array([i for i, k in enumerate(keys) for _ in k], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.int64()), b.column(0).take(repeat), b.column(1).take(repeat)], names=["key", "word", "n"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of every two words with one edit between them, once each."""
    spark = words.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(bigram_counts(words))
    keyed = words.select("word", "n").mapInArrow(_keyed(shared), "key bigint, word string, n bigint")
    x, y = keyed.alias("x"), keyed.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.word") < F.col("y.word")) & (F.levenshtein("x.word", "y.word", 1) == 1)
    return x.join(y, near).select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b")).distinct()


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of every word (see the module)."""
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    near = near_pairs(words).select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= FORM_TIMES * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )


def grouped(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    found = cut(forms(cut(word_counts(df, text_col, id_col))))
    largest = found.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first().n
    steps = int(math.log10(largest)) + 1
    up = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range((steps - 1).bit_length()):  # each round doubles the steps that are taken
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        up = cut(up.join(higher, "root", "left").select("word", F.coalesce("higher", "root").alias("root")))
    return found.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = f"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tbl FROM steps WHERE k = 8),
found AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {SHORTEST} GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))),
    lambda a, b: xor(a >> 8, tbl[(1 + xor(a & 255, b))::INTEGER])), 4294967295) AS h FROM found, crc),
slipped AS (SELECT CASE WHEN h % {SLIP} = 0 THEN concat(substr(run, 1, (h % length(run))::INTEGER), substr(run, (h % length(run))::INTEGER + 2)) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
cuts AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= {FORM_TIMES} * w.n THEN b.other END AS form, CASE WHEN b.m >= {FORM_TIMES} * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
climb(word, top, k) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT c.word, f.form, k + 1 FROM climb c JOIN formed f ON f.word = c.top WHERE f.form IS NOT NULL),
roots AS (SELECT word, last(top ORDER BY k) AS root FROM climb GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
