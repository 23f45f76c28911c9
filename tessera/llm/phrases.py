"""Phrase collocations, mined by pivots as MG-FSM does.

Every phrase belongs to its rarest word, its pivot, at the leftmost place where that
stands.  Texts are cut at punctuation and, since no frequent phrase holds a rare
word, at words of fewer than ``least`` occurrences.  Of what is left each word gets
the fragment that its own phrases can lie in: up to four words to the left that are
all more frequent than it, and up to four to the right that are as frequent or more.
Fragments are dealt by their pivot; a task counts the phrases round the pivot from
the shortest to the longest and drops what can't reach ``least`` any more, so each
phrase is counted by its pivot's task only.  A pivot with more than ``CROWD``
occurrences is dealt by whole fragments over several buckets: their partial counts
are handed on unpruned and summed with the others.

How frequent a word is, tasks read from a table of ``2 ** TABLE_BITS`` numbers that
is sent to them: the largest count of a frequent word in each slot of a hash.  Its
size doesn't depend on the data.  Words that share a slot may look more frequent
than they are; that costs pruning and never changes a count, for all that is needed
is one order of words which all tasks agree on.  Fragments carry words as 64-bit
hashes, the ``COMMON`` most frequent ones (sent too) as numbers; two frequent words of a
language with one hash are an error.

Defined results: a null text is the empty text, a null language is ``und``; rows with
equal texts count as often as they come; words are what stands between spaces and
tabs, so other white space is a part of them; no rows give no rows.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, cut, shuffle_parts, small_batches

LEAST = 100
LONGEST = 5
TOP = 2000
TABLE_BITS = 21
#: Words that fragments name by a short number.
COMMON = 1 << 18
#: Occurrences of a pivot from which its fragments are dealt over several buckets, and fragments that a bucket should have.
CROWD, BUCKET = 250_000, 500_000
#: Distinct words, and words, that a task holds before it hands them on.
FLUSH_WORDS, FLUSH_TOKENS = 400_000, 2_500_000
SEED = 42
BREAK, SPACE = b"\n", b" "
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes.maketrans(_UPPER + _STOPS + b"\t", _UPPER.lower() + BREAK * len(_STOPS) + SPACE)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of a text in UTF-8; a line feed where a piece ends, empty strings between spaces."""
    return (text or "").encode("utf-8").translate(_PLAIN).replace(BREAK, b" \n ").split(SPACE)


def _by_language(langs: pa.Array, texts: pa.Array) -> dict[str, Counter]:
    """Distinct texts of each language, with how often each comes."""
    found: dict[str, Counter] = {}
    for lang, text in zip(langs.to_pylist(), texts.to_pylist()):
        found.setdefault("und" if lang is None else lang, Counter())[text or ""] += 1
    return found


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    held: dict[str, Counter] = {}

    def flush():
        for lang, counts in held.items():
            counts.pop(b"", None), counts.pop(BREAK, None)
            yield batch(schema, [[lang] * (len(counts) + 1), [None, *(w.decode("utf-8") for w in counts)], [sum(counts.values()), *counts.values()]])
        held.clear()

    for b in batches:
        for lang, texts in _by_language(b.column(0), b.column(1)).items():
            counts = held.setdefault(lang, Counter())
            for text, times in texts.items():
                if times == 1:
                    counts.update(tokens(text))
                else:
                    for w, n in Counter(tokens(text)).items():
                        counts[w] += n * times
        if sum(map(len, held.values())) > FLUSH_WORDS:
            yield from flush()
    yield from flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of every word; the row without a word has all occurrences of its language."""
    small_batches(docs.sparkSession)
    return docs.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _slots(hashes: np.ndarray, lang: str) -> np.ndarray:
    own = np.int64(np.uint64(xxhash.xxh64_intdigest(lang, SEED)).astype(np.int64))
    return (hashes ^ own) & ((1 << TABLE_BITS) - 1)


def frequency_table(frequent: DataFrame) -> np.ndarray:
    """The largest count of a frequent word in each slot; what goes through the driver has a fixed size."""
    slot = F.xxhash64("word").bitwiseXOR(F.xxhash64("lang")).bitwiseAND((1 << TABLE_BITS) - 1)
    found = frequent.groupBy(slot.alias("slot")).agg(F.least(F.max("n"), F.lit(2**32 - 1)).alias("n")).toArrow()
    table = np.zeros(1 << TABLE_BITS, np.uint32)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return table


def common_words(frequent: DataFrame) -> np.ndarray:
    """The hashes, sorted, of the ``COMMON`` most frequent words of all languages."""
    own = frequent.groupBy(F.xxhash64("word").alias("hash")).agg(F.max("n").alias("n")).orderBy(F.desc("n"), "hash").limit(COMMON)
    return np.sort(own.select("hash").toArrow()["hash"].to_numpy())


class _Words(dict):
    """Word -> number, from 2 on, as words come; 0 for what stands between spaces, 1 for the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, BREAK: 1})
        self.hashes: list[int] = [0, 0]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word, SEED))
        return n


def fragments(x: np.ndarray, reach: int = LONGEST - 1) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``x`` (ranks, more frequent words higher, -1 where no phrase goes on) that own a phrase, and their fragments (-1 outside)."""
    at = np.flatnonzero(x >= 0) + reach
    x = np.concatenate([np.full(reach, -1, x.dtype), x, np.full(reach, -1, x.dtype)])
    own, out = x[at], np.full((len(at), 2 * reach + 1), -1, np.int32)
    out[:, reach] = own
    for side in (-1, 1):
        open_ = np.ones(len(at), bool)
        for j in range(1, reach + 1):
            other = x[at + side * j]
            open_ &= other > own if side < 0 else other >= own
            out[open_, reach + side * j] = other[open_]
    some = (out[:, reach - 1] >= 0) | (out[:, reach + 1] >= 0)
    return at[some] - reach, out[some]


def _pack(frags: np.ndarray, weights: np.ndarray, hashes: np.ndarray, common: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    """Fragments in the order of pivot and neighbours, equal ones as one with their weights' sum, column by column, after their words.

    A word is told by its place among the common ones or, if it isn't one, by its hash.
    """
    used, local = np.unique(frags, return_inverse=True)
    none = int(used[0] < 0)  # -1, if there is one, comes before all others
    words = hashes[used[none:]]
    place = np.minimum(np.searchsorted(common, words), len(common) - 1)
    rare = common[place] != words if len(common) else np.ones(len(words), bool)
    order = np.lexsort((words, rare))
    number = np.zeros(len(used), np.uint32 if len(used) > 65_000 else np.uint16)
    number[none + order] = np.arange(1, len(words) + 1)
    local, middle = number[local].reshape(frags.shape), LONGEST - 1
    rows = np.lexsort([local[:, middle + side * j] for j in range(middle, 0, -1) for side in (-1, 1)] + [local[:, middle]])
    local, weights = local[rows], weights[rows]
    first = np.flatnonzero(np.append(True, (local[1:] != local[:-1]).any(axis=1)))
    local, weights = local[first], np.add.reduceat(weights.astype(np.int64), first)
    steps = np.diff(place[order][: len(words) - int(rare.sum())], prepend=0).astype("<u4")
    body = steps.view(np.uint8).reshape(-1, 4).T.tobytes() + words[order][len(steps) :].astype("<i8").tobytes() + np.ascontiguousarray(local.T).tobytes() + weights.astype("<i8").tobytes()
    return z.compress(struct.pack("<IIIB", len(steps), len(words) - len(steps), len(local), local.itemsize) + body)


def _unpack(blob: bytes, common: np.ndarray, z: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, fragments (numbers of hashes, -1 for none) and weights."""
    data = z.decompress(blob)
    known, rare, rows, size = struct.unpack_from("<IIIB", data)
    at, width = 13, 2 * LONGEST - 1
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * known, at).reshape(4, known).T).view("<u4").reshape(-1)
    hashes = np.concatenate([common[np.cumsum(steps, dtype=np.int64)], np.frombuffer(data, "<i8", rare, at := at + 4 * known)])
    local = np.frombuffer(data, f"<u{size}", width * rows, at := at + 8 * rare).reshape(width, rows).T.astype(np.int64) - 1
    return hashes, local, np.frombuffer(data, "<i8", rows, at + size * width * rows)


def _route(shared, buckets: int, crowd_size: int):
    """Texts -> rows (bucket, lang, crowded, packed fragments)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("crowded", pa.bool_()), ("packed", pa.binary())])
        (table, common), z, words, held, size = shared.value, zstandard.ZstdCompressor(level=6), _Words(), {}, 0

        def flush():
            hashes = np.array(words.hashes, np.uint64).view(np.int64)
            for lang, runs in held.items():
                ids, times = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
                count = table[_slots(hashes, lang)].astype(np.int64)
                count[:2] = 0
                order = np.lexsort((hashes, count))
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                rank[count == 0] = -1
                at, frags = fragments(rank[ids])
                if not len(at):
                    continue
                pivot = order[frags[:, LONGEST - 1]]
                spread = -(-count[pivot] // crowd_size)
                mixed = (hashes[pivot] ^ _slots(np.zeros(1, np.int64), lang)).view(np.uint64)
                if (crowd := spread > 1).any():  # whole fragments decide where those of a crowded pivot go
                    own = np.zeros(int(crowd.sum()), np.uint64)
                    for column in frags[crowd].T:
                        own = (own * np.uint64(0x9E3779B97F4A7C15)) ^ np.where(column >= 0, hashes[order[column]], -1).view(np.uint64)
                    mixed[crowd] += (own >> np.uint64(17)) % spread[crowd].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                bucket = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64) % buckets * 2 + crowd
                by = np.argsort(bucket, kind="stable")
                bounds = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
                sorted_hashes, weights = hashes[order], times[at]
                out = [(int(b) // 2, lang, bool(b % 2), _pack(frags[part], weights[part], sorted_hashes, common, z)) for part in np.split(by, bounds[1:-1]) for b in bucket[part[:1]]]
                for i in range(0, len(out), 64):
                    yield batch(schema, list(zip(*out[i : i + 64])))
            held.clear()

        for b in batches:
            for lang, texts in _by_language(b.column(0), b.column(1)).items():
                for text, times in texts.items():
                    found = tokens(text)
                    found.append(BREAK)
                    ids = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                    ids = ids[ids > 0]
                    held.setdefault(lang, []).append((ids, np.full(len(ids), times, np.int32)))
                    size += len(ids)
            if size > FLUSH_TOKENS:
                yield from flush()
                words, size = _Words(), 0
        yield from flush()

    return run


def mine(frags: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases round the pivots (middle column) with ``least`` occurrences or more, shortest first: rows of numbers, and counts."""
    middle, width = LONGEST - 1, int(frags.max(initial=0)) + 1
    state = {(0, 0): (np.arange(len(frags)), frags[:, middle])}
    for left in range(LONGEST):
        for right in range(LONGEST - left):
            if not left and not right:
                continue
            rows, code = state[(left, right - 1) if right else (left - 1, 0)]
            added = frags[rows, middle + right if right else middle - left]
            rows, code, added = rows[added >= 0], code[added >= 0], added[added >= 0]
            _, first, code = np.unique(code * width + added, return_index=True, return_inverse=True)
            counts = np.bincount(code, weights[rows], len(first)).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
            enough = counts >= least
            if enough.any():
                yield frags[rows[first[enough]], middle - left : middle + right + 1], counts[enough]
            keep = enough[code] if len(rows) else np.zeros(0, bool)
            state[left, right] = rows[keep], code[keep]


def _mine_buckets(shared, least: int):
    """Rows of _route, sorted by bucket, language and crowded -> lang, words (hashes), a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.int64())), ("a", pa.int64())])
        common, z, key, held = shared.value[1], zstandard.ZstdDecompressor(), None, []

        def flush():
            if not held:
                return
            hashes, at = np.unique(np.concatenate([h for h, _, _ in held]), return_inverse=True)
            starts, numbered = np.cumsum([0, *(len(h) for h, _, _ in held)]), []
            for (_, f, _), start in zip(held, starts):
                numbered.append(np.where(f >= 0, at[np.maximum(f, 0) + start], -1).astype(np.int32))
            frags, weights = np.concatenate(numbered).astype(np.int64), np.concatenate([w for _, _, w in held])
            held.clear()
            for rows, counts in mine(frags, weights, 1 if key[2] else least):
                for i in range(0, len(rows), 50_000):
                    part = hashes[rows[i : i + 50_000]]
                    lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(part), pa.string()), lists, pa.array(counts[i : i + 50_000])], schema=schema)

        for b in batches:
            for *own, packed in zip(*(c.to_pylist() for c in b.columns)):
                if own != key:
                    yield from flush()
                    key = own
                held.append(_unpack(packed, common, z))
        yield from flush()

    return run


def phrase_counts(docs: DataFrame, frequent: DataFrame, total: int, least: int = LEAST, crowd_size: int = CROWD) -> DataFrame:
    """lang, words (hashes, in order), a of every phrase of two to five words with ``least`` occurrences or more."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_parts(spark)
    buckets = max(2 * parts, -(-total // BUCKET))
    shared = spark.sparkContext.broadcast((frequency_table(frequent), common_words(frequent)))
    routed = docs.select("lang", "text").mapInArrow(_route(shared, buckets, crowd_size), "bucket int, lang string, crowded boolean, packed binary")
    dealt = routed.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang", "crowded")
    found = dealt.mapInArrow(_mine_buckets(shared, least), "lang string, words array<bigint>, a bigint")
    return found.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, crowd_size: int = CROWD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases (see the module).

    The score of a phrase is that of its worst cut, floor(1000 * a * n / (l * r)); what
    lies in a longer candidate with as many occurrences is dropped.
    """
    docs = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = cut(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()))
    totals = counted.where("word IS NULL").select("lang", F.col("n").alias("total"))
    frequent = counted.where(F.col("word").isNotNull() & (F.col("n") >= least))
    total = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first().n
    one_word = F.when(F.count("*") > 1, F.raise_error(F.lit("two frequent words share a hash: take another SEED"))).otherwise(F.min("word"))
    known = frequent.groupBy("lang", F.xxhash64("word").alias("hash")).agg(one_word.alias("word"), F.max("n").alias("n"))
    found = cut(phrase_counts(docs, frequent, total, least, crowd_size))
    parts_of = found.select("lang", "words", F.col("a").alias("f")).unionByName(known.select("lang", F.array("hash").alias("words"), F.col("n").alias("f")))
    size = F.size("words")
    inner = lambda start: found.where(size > 2).select("lang", F.slice("words", start, size - 1).alias("words"), F.col("a").alias("longer"))
    longer = inner(1).unionByName(inner(2)).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = found.join(longer, ["lang", "words"], "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).join(totals, "lang")
    cuts = kept.select("lang", "words", "a", "total", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    side = lambda name, count: parts_of.select("lang", F.col("words").alias(name), F.col("f").alias(count))
    both = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(a19 * n19 * CAST(1000 AS DECIMAL(4,0))) div (l19 * r19)")
    scored = both.withColumns({f"{c}19": wide(x) for c, x in (("a", "a"), ("n", "total"), ("l", "l"), ("r", "r"))}).withColumn("score", score)
    worst = scored.groupBy("lang", "words", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    spelled = worst.select("*", F.posexplode("words").alias("at", "hash")).join(known.select("lang", "hash", "word"), ["lang", "hash"])
    lined = F.array_sort(F.collect_list(F.struct("at", "word")))
    phrases = spelled.groupBy("lang", "words", "a", "total", "worst").agg(F.array_join(lined.getField("word"), " ").alias("phrase"))
    ranked = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "worst.l", "worst.r", F.col("total").alias("n"), "worst.score")


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
split AS (SELECT lang, piece, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, list_slice(w, i, i + size - 1) AS g, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, (SELECT unnest(range(1, {LONGEST + 1})) AS size) WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= {LEAST}),
inner_of AS (
  SELECT lang, g, max(f) AS f FROM (
    SELECT lang, list_slice(g, 1, len(g) - 1) AS g, f FROM grams WHERE len(g) > 2
    UNION ALL SELECT lang, list_slice(g, 2, len(g)) AS g, f FROM grams WHERE len(g) > 2) GROUP BY ALL),
kept AS (
  SELECT c.lang, c.g, c.f AS a, t.n FROM grams c JOIN totals t USING (lang) LEFT JOIN inner_of i ON i.lang = c.lang AND i.g = c.g
  WHERE len(c.g) > 1 AND coalesce(i.f < c.f, true)),
cuts AS (
  SELECT k.lang, k.g, k.a, k.n, k.k, x.f AS l, y.f AS r, CAST((CAST(1000 AS HUGEINT) * k.a * k.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM kept) k
  JOIN grams x ON x.lang = k.lang AND x.g = list_slice(k.g, 1, k.k) JOIN grams y ON y.lang = k.lang AND y.g = list_slice(k.g, k.k + 1, len(k.g))),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
