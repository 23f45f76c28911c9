"""The training-corpus pipeline over ``documents``: five stages, each over all that the one before it kept.

1. language ID: learned from the labelled rows; documents whose language can't be told
   with a score of ``LEAST_SCORE`` (as likely as all others together) go.
2. SimHash near-dedup: five-word shingles, similarity 0.8 or more; one document of each group stays.
3. secret scan: secrets are replaced by a mark, each distinct text being scanned once.
4. mixing: the rows are laid out in the order in which Pfair scheduling mixes the
   sources to their target weights; file after file, row after row is the mix.
5. BPE: token ids of every text, and digests of ids and decoded text.

Stages 1 to 4 return the columns of ``documents``, and all others that their input has,
whatever their names.  Null texts count as empty: they have no language and go in stage
1.  Repeated rows are exact copies of each other, of which stage 2 keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, langid, mixing, secrets, simhash
from tessera.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.told(docs, langid.fit(docs), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.laid_out(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, VOCABULARY, with_text=False)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("pfair_mixing", mix_sources),
    ("bpe_codec", bpe_codec),
]

#: Near-dedup, mixing and BPE can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
