"""Which of many terms occur in which texts, in one pass over each text.

The terms make an Aho-Corasick automaton.  If they are few (their characters are
counted against ``SENT_CHARS``) it is sent to every task and texts are read where they
are.  More terms are dealt into parts of that size and the texts into portions; each
pair of a part and a portion is one group, so a task holds one part's automaton and
one portion of texts, whatever there is of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the terms of one automaton, and of the texts of one portion where there are several.
SENT_CHARS, PORTION_CHARS = 4 << 20, 16 << 20


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t, (t, len(t)))
    found.make_automaton()
    return found


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _in_text(automaton: ahocorasick.Automaton, text: str, whole_words: bool) -> set[str]:
    """The distinct terms in a text; as whole words: where a word character meets another kind (or an end) on both sides."""
    found: set[str] = set()
    for end, (term, n) in automaton.iter(text):
        if term in found:
            continue
        begin = end - n + 1
        if not whole_words or (_word(text[begin]) != (begin > 0 and _word(text[begin - 1])) and _word(text[end]) != (end + 1 < len(text) and _word(text[end + 1]))):
            found.add(term)
    return found


def _rows(automaton, ids: list, texts: list, whole_words: bool) -> tuple[list, list]:
    found = [_in_text(automaton, t, whole_words) if t and len(automaton) else () for t in texts]
    return [i for i, x in zip(ids, found) for _ in x], [t for x in found for t in x]


def occurrences(texts: DataFrame, text_id: str, text: str, terms: DataFrame, term: str, whole_words: bool, sent_chars: int = SENT_CHARS, portion_chars: int = PORTION_CHARS) -> DataFrame:
    """text_id, term of every term that occurs in a text, once a row of ``texts``.

    Comparison is exact, so bring both to one case first.  Null texts and null terms have no part; the empty term is in every
    text, unless whole words are asked for.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(text_id).alias(text_id), F.col(text).alias("t")).where(F.col("t").isNotNull())
    own = terms.select(F.col(term).alias("term")).where(F.col("term").isNotNull()).distinct()
    size = own.agg(F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("n"), F.count_if(F.col("term") == "").alias("empty")).first()
    kind = texts.schema[text_id].dataType
    schema = f"`{text_id}` {kind.simpleString()}, term string"
    listed = own.where("term <> ''")
    if size.n <= sent_chars:
        shared = spark.sparkContext.broadcast([r.term for r in listed.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared.value)
            for b in batches:
                ids, found = _rows(automaton, list(range(b.num_rows)), b.column(1).to_pylist(), whole_words)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), pa.array(found, pa.string())], names=[text_id, "term"])

        hits = rows.mapInArrow(run, schema)
    else:
        parts = -(-size.n // sent_chars)
        portions = max(1, -(-(rows.agg(F.sum(F.length("t"))).first()[0] or 0) // portion_chars))
        dealt_terms = listed.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts))).withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))
        dealt_rows = rows.withColumn("portion", F.pmod(F.xxhash64(text_id, "t"), F.lit(portions))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def pair(texts_of: pa.Table, terms_of: pa.Table) -> pa.Table:
            ids, found = _rows(_automaton(terms_of["term"].to_pylist()), list(range(texts_of.num_rows)), texts_of["t"].to_pylist(), whole_words)
            return pa.table({text_id: texts_of[text_id].take(pa.array(ids, pa.int32())), "term": pa.array(found, pa.string())})

        hits = dealt_rows.groupBy("part", "portion").cogroup(dealt_terms.groupBy("part", "portion")).applyInArrow(pair, schema)
    if size.empty and not whole_words:
        hits = hits.unionByName(rows.select(text_id, F.lit("").alias("term")))
    return hits
