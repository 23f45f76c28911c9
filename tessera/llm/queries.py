"""The registered queries of this subpackage: thin contracts over its operators, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, cdc, extract, hnsw, imatch, langid, mixing, phrases, secrets, simhash, suffix, variants, warc
from tessera.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False, with_text=False)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses if repeated strings of 100 bytes are removed."""
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op2_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What content-defined chunking removes from every document."""
    return cdc.dedup(table(spark, sf_dir, "documents"))


def op3_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.groups(table(spark, sf_dir, "documents"))


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document comes in the mix of its sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix.*")


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in every document, scanned once for each distinct text."""
    return secrets.findings(table(spark, sf_dir, "documents"))


def op8_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives written from all pages hold when they are read back."""
    records = warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return imatch.compare_with_edit(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with the form that it is a variant of."""
    return variants.grouped(table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract.main_texts(table(spark, sf_dir, "pages"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op4_bpe_codec": op4_bpe_codec,
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_cdc_dedup": op2_cdc_dedup,
    "op3_hnsw_neighbours": op3_hnsw_neighbours,
    "op5_simhash_golay": op5_simhash_golay,
    "op6_pfair_mixing": op6_pfair_mixing,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_warc_roundtrip": op8_warc_roundtrip,
    "op9_language_id": op9_language_id,
    "op10_imatch_fingerprints": op10_imatch_fingerprints,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_html_extraction": op12_html_extraction,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op7_secret_ledger": secrets.ORACLE_SQL,
    "op11_spelling_variants": variants.ORACLE_SQL,
    "op13_phrase_collocations": phrases.ORACLE_SQL,
}
