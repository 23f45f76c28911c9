"""Language identification by a word-first backoff model.

A known word is scored by its log frequency in each language.  A word that no
language knows is scored by its character 4-grams; where one of these is unknown
the 3-gram that starts there is taken, then the 2-gram, then the letter.

The model is fitted on about ``SAMPLE_DOCS`` labelled documents of each language
(chosen by a hash of the id).  It keeps words and n-grams that make up a share of
1/``RAREST`` or more of their language's sample, so at most ``RAREST`` of either for
each language, whatever the corpus holds; of a word only the languages that have it
are stored.  A model of more than ``MODEL_ENTRIES`` such entries at most is too large
to be sent to every task and is refused by an error: no language is ever left out.
Prediction is per row, without a shuffle, over whole texts.

Defined results: text null or without a letter gives ``und`` with score 0, as
does every text when nothing could be learned; rows whose label is null are not
learned from; a null id is never held out and never learned from; ties go to the
language that sorts first; repeated rows give one row each.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, packed, small_batches, texts_of

SAMPLE_DOCS = 4_000
RAREST = 20_000
MODEL_ENTRIES = 16_000_000
MAX_GRAM = 4
#: Scores of chunks of text that a worker remembers, and how long the chunks may be.
CACHE_SCORES = 1_000_000
CACHE_CHUNK_CHARS = 64
#: Scores of words and of n-grams that a worker remembers written out for all languages.
RECENT_SCORES = 100_000
#: Scores of stretches of unknown words that a worker remembers, after backing off.
STRETCH_SCORES = 800_000
#: Different words or n-grams that a task counts before it hands its counts on.
COUNTED = 200_000
#: Words that count as evidence at most, for the score; more would always give 1.
EVIDENCE_WORDS = 12
UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}+")


def held_out(id_col: Column) -> Column:
    """True for ids whose CRC-32 (of their decimal text) leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def grams(word: str) -> list[str]:
    """Every n-gram of 1 to ``MAX_GRAM`` letters of the word between its end marks."""
    w = f"^{word}$"
    return [w[i : i + n] for n in range(1, MAX_GRAM + 1) for i in range(len(w) - n + 1)]


@dataclass
class Table:
    """Log frequencies by key: for each key the languages that have it and by how much it is above ``floor`` there, one after the other."""

    entries: dict[str, tuple]
    floor: list[float]
    recent: dict[str, list[float]] = field(default_factory=dict)

    def scores(self, key: str) -> list[float] | None:
        """The key's score in each language, or nothing if it is not known."""
        if (out := self.recent.get(key)) is not None:
            return out
        known = self.entries.get(key)
        if known is None:
            return None
        out = list(self.floor)
        for i in range(0, len(known), 2):
            out[known[i]] += known[i + 1]
        if len(self.recent) * len(out) < RECENT_SCORES:
            self.recent[key] = out
        return out


@dataclass
class Model:
    """Scores of words and n-grams in each of ``langs``."""

    langs: list[str]
    words: Table
    grams: Table
    stretches: dict[str, list[float]] = field(default_factory=dict)

    def score_stretch(self, stretch: str) -> list[float]:
        """The scores of the longest known n-gram that a stretch of ``MAX_GRAM`` letters (or a shorter word) starts with."""
        known = next((x for size in range(MAX_GRAM, 0, -1) if (x := self.grams.scores(stretch[:size])) is not None), self.grams.floor)
        if len(self.stretches) * len(known) < STRETCH_SCORES:
            self.stretches[stretch] = known
        return known

    def score_word(self, word: str) -> list[float]:
        if (known := self.words.scores(word)) is not None:
            return known
        w, get = f"^{word}$", self.stretches.get
        stretches = [w[i : i + MAX_GRAM] for i in range(max(1, len(w) - MAX_GRAM + 1))]
        n = len(stretches)
        return [sum(x) / n for x in zip(*[get(s) or self.score_stretch(s) for s in stretches])]

    def score_chunk(self, chunk: str) -> list[float]:
        """Sums of the scores of the words of a text, and the number of words."""
        words = _WORD.findall(chunk)
        if not words:
            return [0.0] * (len(self.langs) + 1)
        return [*map(sum, zip(*map(self.score_word, words))), float(len(words))]


class Scorer:
    """Predicts with a model, remembering what it found for chunks between white space."""

    def __init__(self, model: Model):
        self.model, self.rows, self.at = model, np.zeros((1024, len(model.langs) + 1)), {}

    def _row(self, chunk: str) -> int:
        """The row in which the chunk's scores are remembered, or -1 if there is no room for them."""
        if (len(self.at) + 1) * self.rows.shape[1] > CACHE_SCORES or len(chunk) > CACHE_CHUNK_CHARS:
            return -1
        k = len(self.at)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.model.score_chunk(chunk)
        self.at[chunk] = k
        return k

    def predict(self, text: str) -> tuple[str, float]:
        if not self.model.langs:
            return UNDETERMINED, 0.0
        chunks, get = text.lower().split(), self.at.get
        found = [i if (i := get(c)) is not None else self._row(c) for c in chunks]
        total = self.rows[[i for i in found if i >= 0]].sum(axis=0)
        for c, i in zip(chunks, found) if -1 in found else ():
            if i < 0:
                total = total + np.array(self.model.score_chunk(c))
        n = total[-1]
        if not n:
            return UNDETERMINED, 0.0
        x = total[:-1] / n * min(n, EVIDENCE_WORDS)
        e = np.exp(x - x.max())
        best = int(np.argmax(x))
        return self.model.langs[best], float(e[best] / e.sum())


def _counts(schema: pa.Schema, found: dict[str, Counter]) -> pa.RecordBatch:
    """Rows of (lang, key, n) of what was counted, which starts anew."""
    columns = [[lang for lang, c in found.items() for _ in c], [k for c in found.values() for k in c], [n for c in found.values() for n in c.values()]]
    found.clear()
    return batch(schema, columns)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    found: dict[str, Counter] = defaultdict(Counter)
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
            found[lang].update(_WORD.findall(text.lower()))
        if sum(map(len, found.values())) > COUNTED:
            yield _counts(schema, found)
    yield _counts(schema, found)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    found: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for b in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
            counts = found[lang]
            for g in grams(word):
                counts[g] += n
        if sum(map(len, found.values())) > COUNTED:
            yield _counts(schema, found)
    yield _counts(schema, found)


def _table(rows: list[tuple[str, str, int]], langs: list[str]) -> Table:
    """Smoothed log frequencies of (lang, key, n)."""
    counts: dict[str, list[tuple[int, int]]] = {}
    totals, number = np.zeros(len(langs)), {g: i for i, g in enumerate(langs)}
    for lang, key, n in rows:
        counts.setdefault(key, []).append((number[lang], n))
        totals[number[lang]] += n
    # log((n + 0.5) / all) in the languages that have a key, and log(0.5 / all) in the others
    floor = np.log(0.5) - np.log(totals + 0.5 * (len(counts) + 1))
    return Table({k: tuple(x for i, n in c for x in (i, math.log((n + 0.5) / 0.5))) for k, c in counts.items()}, floor.tolist())


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from a bounded sample of the labelled rows of ``df`` (see the module's description)."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("id is not null and lang is not null and text is not null")
    most = MODEL_ENTRIES // (2 * RAREST)
    sizes = rows.groupBy("lang").count().limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: the model would be too large to send to every task; merge labels or raise MODEL_ENTRIES")
    if not sizes:
        return Model([], Table({}, []), Table({}, []))
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, min(1.0, SAMPLE_DOCS / n))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")) * 1_000_000).select("lang", "text")
    words = sample.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def frequent(counts: DataFrame, key: str) -> list[tuple]:
        totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()
        if not totals:
            return []
        total = F.create_map(*[F.lit(x) for lang, n in totals for x in (lang, n)])
        return [tuple(r) for r in counts.where(F.col("n") * RAREST >= F.try_element_at(total, F.col("lang"))).select("lang", key, "n").collect()]

    words = words.persist()
    try:
        n_grams = words.mapInArrow(_count_grams, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
        known, by_gram = frequent(words, "word"), frequent(n_grams, "gram")
        n_grams.unpersist()
    finally:
        words.unpersist()
    langs = sorted({lang for lang, _, _ in known})
    return Model(langs, _table(known, langs), _table(by_gram, langs))


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` narrowed to the columns ``keep`` (all by default) with ``lang_pred`` and ``score`` added, in place of any of these names."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    names = [f"c{i}" for i in range(len(columns))]
    src = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)], F.col(f"`{text_col}`").alias("text"))
    schema = src.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in batches:
            got = [scorer.predict(t) for t in texts_of(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return src.mapInArrow(run, schema).toDF(*columns, "lang_pred", "score")


def told(df: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, unchanged, whose language the model tells with a score of ``least`` or more.

    A model that learned no language tells nothing about texts, so it keeps all that have a letter.
    """
    rows = packed(df, text=F.col(f"`{text_col}`"))
    if not model.langs:
        return rows.where(F.col("text").rlike(r"\p{L}")).select("row.*")
    sure = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)
    return predict(rows, model, keep=["row"]).where(sure).select("row.*")


_SCORERS: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    """One scorer for each worker process and model."""
    key = id(shared.value)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value)
    return _SCORERS[key]


def identify(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    model = fit(df.where(~held_out(F.col(id_col))), text_col, lang_col, id_col)
    src = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(src, model, keep=["doc_id", "held_out"])
