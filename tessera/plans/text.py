"""Registered queries over the text, key and record functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.expressions import small_batches
from tessera.functions.html import html_to_text, page_blocks
from tessera.operators import relational as R
from tessera.plans.registry import query
from tessera.plans.relational import tab

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_URL = f"""
    SELECT page_id, scheme || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM (
      SELECT *, CASE WHEN len(ids) > 0 THEN ids ELSE list_filter(items, lambda x: NOT list_contains({_LIST(T.TRACKING_PARAMS)}, lower(split_part(x, '=', 1)))) END AS kept FROM (
        SELECT *, list_filter(items, lambda x: list_contains({_LIST(T.ID_PARAMS)}, lower(split_part(x, '=', 1))) AND split_part(x, '=', 2) <> '') AS ids FROM (
          SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
                 regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
                 list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '') AS items FROM (SELECT page_id, trim(url) AS url FROM pages))))"""


@query("q_url_canonical", _URL)
def url_canonical(spark, sf_dir):
    (pages,) = tab(spark, sf_dir, "pages")
    return pages.select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


_NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(
    "q_identity_dedupe",
    f"SELECT DISTINCT ON (identity_key) identity_key, doc_id FROM (SELECT doc_id, 'role:' || {_NORM.format('source')} || '|' || {_NORM.format('text')} || '|' || {_NORM.format('lang')} AS identity_key FROM documents WHERE {_NORM.format('text')} <> '') ORDER BY identity_key, doc_id",
)
def identity_dedupe(spark, sf_dir):
    (documents,) = tab(spark, sf_dir, "documents")
    keyed = documents.select("doc_id", T.identity_key(F.lit(None).cast("string"), F.col("source"), F.col("text"), F.col("lang")).alias("identity_key"))
    return R.first_per_group(keyed.where("identity_key is not null"), ["identity_key"], [F.asc("doc_id")]).select("identity_key", "doc_id")


@query("q_content_hash", "SELECT hash, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(text, '')) AS hash FROM documents) GROUP BY 1")
def content_hash(spark, sf_dir):
    (documents,) = tab(spark, sf_dir, "documents")
    return documents.select("doc_id", T.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("q_queue_key", "SELECT queue_key, count(*) AS n FROM (SELECT 'queue:' || trim(regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS queue_key FROM part) GROUP BY 1")
def queue_keys(spark, sf_dir):
    (part,) = tab(spark, sf_dir, "part")
    suffixed = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" - Austin, TX, USA"))).otherwise(F.col("p_name"))
    return part.select(T.queue_key(F.col("p_brand"), suffixed, F.lit(None).cast("string")).alias("queue_key")).groupBy("queue_key").agg(F.count("*").alias("n"))


@query("q_links_fingerprint", "SELECT page_id, len(l) AS links, len(list_distinct(l)) AS distinct_links, len(list_filter(l, lambda x: starts_with(x, '/'))) AS own FROM (SELECT page_id, regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1) AS l FROM pages)")
def links_fingerprint(spark, sf_dir):
    (pages,) = tab(spark, sf_dir, "pages")
    links = pages.select("page_id", F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1)).alias("l"))
    size = lambda c: F.size(c).cast("long")
    return links.select("page_id", size("l").alias("links"), size(F.array_distinct("l")).alias("distinct_links"), size(F.filter("l", lambda x: x.startswith("/"))).alias("own"))


@query("q_html_text")
def html_text(spark, sf_dir):
    """The parser's tree has no SQL form; tested on golden rows."""
    small_batches(spark)
    (pages,) = tab(spark, sf_dir, "pages")
    return pages.select("page_id", html_to_text("html").alias("text"))


@query("q_html_blocks")
def html_blocks_of_pages(spark, sf_dir):
    """Blocks and their characters by kind on every page; that the blocks make up ``q_html_text`` is tested."""
    small_batches(spark)
    (pages,) = tab(spark, sf_dir, "pages")
    return page_blocks(pages, "page_id", "html").groupBy("page_id", "kind").agg(F.count("*").alias("blocks"), F.sum(F.length("block")).alias("chars"))


@query(
    "q_hash_embedding",
    "SELECT item_id, idx, CAST(round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS DOUBLE) AS weight FROM (SELECT item_id, CAST(('0x' || substr(sha256(token), 1, 8))::BIGINT % 768 AS INTEGER) AS idx, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY 1, 2)",
)
def hash_embedding(spark, sf_dir):
    """A normalized hashed bag of words, in its sparse form (item, place, weight)."""
    (benchmark,) = tab(spark, sf_dir, "benchmark")
    tokens = benchmark.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    counts = tokens.groupBy("item_id", T.bag_index(F.col("token")).alias("idx")).agg(F.count("*").alias("n"))
    norms = counts.groupBy("item_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, "item_id").select("item_id", "idx", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))


@query("q_verbatim_verify", "SELECT b.item_id, count(d.doc_id) AS found_in, min(d.doc_id) AS first_doc FROM (SELECT item_id, lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS s FROM benchmark) b LEFT JOIN (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM documents) d ON contains(t, s) GROUP BY 1")
def verbatim_verify(spark, sf_dir):
    benchmark, documents = tab(spark, sf_dir, "benchmark", "documents")
    quotes, texts = benchmark.select("item_id", T.verbatim_norm(F.col("text")).alias("s")), documents.select("doc_id", T.verbatim_norm(F.col("text")).alias("t"))
    return R.quoted_in(quotes, texts, "item_id", "doc_id")


@query("q_keyword_builder", "SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9+#.]+'), lambda w: length(w) >= 5 AND NOT list_contains(['plated', 'brushed'], w)))) AS words FROM part")
def keyword_builder(spark, sf_dir):
    (part,) = tab(spark, sf_dir, "part")
    words = T.keywords(F.concat_ws(" ", "p_type", "p_name"), ["plated", "brushed"], 5)
    return part.select("p_partkey", F.array_sort(words).alias("words"))


@query(
    "q_age_labels",
    "SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago' ELSE s // 86400 || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM (SELECT event_id, greatest((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) // 1000000, 0) AS s FROM events)",
)
def age_labels(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    return events.select("event_id", T.age_label(F.col("ts"), F.lit("2024-01-20").cast("timestamp_ntz")).alias("age"))


@query("q_display_names", "SELECT DISTINCT n_name, upper(left(a, 1)) || lower(substr(a, 2)) || '_' || b AS shown FROM (SELECT n_name, split_part(n_name, '_', 1) AS a, split_part(n_name, '_', 2) AS b FROM nation)")
def display_names(spark, sf_dir):
    (nation,) = tab(spark, sf_dir, "nation")
    return nation.select("n_name", T.title_case(F.col("n_name")).alias("shown")).distinct()
