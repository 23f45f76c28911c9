"""The best answer to each question by the cosine of their vectors, within a scope.

Questions and answers of a scope are dealt into blocks of about ``BLOCK`` rows; what is
joined are blocks, and a pair of blocks is one matrix product, of which each question
keeps its best answer only.  So no row is made for a pair of vectors, a scope that holds
most rows is spread over as many tasks as it has pairs of blocks, and a task holds two
blocks.  An answer without a scope is for all questions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512
#: Decimals of a cosine; answers that agree in them are told apart by their id.
DECIMALS = 6
EVERYWHERE = "*"
#: Fixed value: cosine from which an answer counts.
LIKE_ENOUGH = 0.85


def _blocks(df: DataFrame, name: str, size: int) -> DataFrame:
    """scope, and a block's ids and vectors, of rows (scope, id, vector); vectors of no length or with a null or infinite component are left out."""
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    usable = df.withColumn("vector", F.transform("vector", lambda x: x.cast("double"))).where((length > 0) & (length < float("inf")) & F.col("id").isNotNull())
    counts = usable.groupBy("scope").agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = usable.join(counts, "scope").withColumn("block", F.pmod(F.xxhash64("id", "vector"), "blocks"))
    return dealt.groupBy("scope", "block").agg(F.collect_list(F.struct("id", "vector")).alias(name)).select("scope", name)


def _matrix(block: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    rows = block.values
    ids, vectors = rows.field("id").to_numpy(zero_copy_only=False), rows.field("vector")
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return ids, m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for asked, answers in zip(b.column(0), b.column(1)):
            (q, qm), (a, am) = _matrix(asked), _matrix(answers)
            order = np.argsort(a, kind="stable")  # of equal cosines the smallest id comes first
            a, cosines = a[order], np.round(qm @ am[order].T, DECIMALS)
            cosines[q[:, None] == a[None, :]] = -2
            at = cosines.argmax(axis=1)
            found = cosines[np.arange(len(q)), at]
            keep = found >= -1
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(a[at[keep]]), pa.array(found[keep])], names=["query_id", "id", "cosine"])


def best_answers(questions: DataFrame, answers: DataFrame, threshold: float = LIKE_ENOUGH, block: int = BLOCK) -> DataFrame:
    """query_id, id, cosine of each question's best answer, if their cosine is ``threshold`` or more.

    Both sides: id (long), scope (string), vector (equally many components).  A question without a scope has the answers
    without one only; a question is no answer to itself (equal ids); of equal answers the one of the smallest id is taken.
    """
    own = questions.where(F.col("scope").isNotNull() & (F.col("scope") != EVERYWHERE))
    asked = _blocks(own.select("scope", "id", "vector").unionByName(questions.select(F.lit(EVERYWHERE).alias("scope"), "id", "vector")), "asked", block)
    held = _blocks(answers.select(F.coalesce("scope", F.lit(EVERYWHERE)).alias("scope"), "id", "vector"), "answers", block)
    pairs = asked.join(held, "scope").select("asked", "answers")
    found = pairs.mapInArrow(_best, "query_id bigint, id bigint, cosine double")
    best = found.groupBy("query_id").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "id")).alias("best"))
    return best.select("query_id", "best.id", (-F.col("best.less")).alias("cosine")).where(F.col("cosine") >= threshold)


def scoped(df: DataFrame, id_: str, scope: Column, vector: str) -> DataFrame:
    """A table in the form that ``best_answers`` takes."""
    return df.select(F.col(id_).cast("long").alias("id"), scope.cast("string").alias("scope"), F.col(vector).alias("vector"))
