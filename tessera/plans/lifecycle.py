"""Registered queries over snapshots, source states and schedules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import backfill as B
from tessera.operators import lifecycle as L
from tessera.operators import relational as R
from tessera.plans.registry import query
from tessera.plans.relational import as_of, tab
from tessera.streaming.events import scratch


@query(
    "q_snapshot_diff",
    """WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'), a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-09-01'),
    e AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01' AND o_custkey NOT IN (SELECT k FROM a))
    SELECT k, CASE WHEN a.k IS NOT NULL AND f.k IS NOT NULL THEN 'present' WHEN a.k IS NOT NULL THEN 'missing' WHEN e.k IS NOT NULL THEN 'reappeared' ELSE 'new' END AS state FROM f FULL JOIN a USING (k) FULL JOIN e USING (k) WHERE f.k IS NOT NULL OR a.k IS NOT NULL""",
)
def snapshot_diff(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    keys = lambda cond: orders.where(cond).select(F.col("o_custkey").alias("k")).distinct()
    active = keys("o_orderdate BETWEEN TIMESTAMP_NTZ '1999-01-01' AND TIMESTAMP_NTZ '1999-09-01'")
    return R.diff(keys("o_orderdate >= TIMESTAMP_NTZ '2000-01-01'"), active, keys("o_orderdate < TIMESTAMP_NTZ '1996-06-01'").join(active, "k", "left_anti"), "k")


_SLICES = """WITH b AS (SELECT o_orderpriority AS source, o_custkey AS key, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS hash, o_orderdate < TIMESTAMP '1998-01-01' AS old, bool_or(o_orderstatus = 'P') AS part FROM orders GROUP BY 1, 2, 4),
    c AS (SELECT source, key, hash, CASE WHEN key % 4 = 0 THEN TIMESTAMP '1997-06-01' END AS expired_at, 'ok' AS status FROM b WHERE old), f AS (SELECT source, key, hash, CASE WHEN part THEN 'pending' ELSE 'ok' END AS status FROM b WHERE NOT old AND source <> '5-LOW')"""


@query(
    "q_lifecycle_merge",
    _SLICES
    + """ SELECT coalesce(c.source, f.source) AS source, coalesce(c.key, f.key) AS key,
    CASE WHEN c.hash IS NULL THEN f.hash WHEN f.hash IS NULL THEN c.hash WHEN f.status = 'pending' THEN c.hash ELSE f.hash END AS hash,
    CASE WHEN c.hash IS NULL THEN f.status ELSE 'ok' END AS status, CASE WHEN c.hash IS NULL THEN TIMESTAMP '2001-08-01' ELSE TIMESTAMP '1997-01-01' END AS first_seen, CASE WHEN f.hash IS NULL THEN TIMESTAMP '1997-01-01' ELSE TIMESTAMP '2001-08-01' END AS last_seen,
    CASE WHEN f.hash IS NOT NULL THEN NULL WHEN coalesce(c.source, f.source) <> '5-LOW' THEN coalesce(c.expired_at, TIMESTAMP '2001-08-01') ELSE c.expired_at END AS expired_at, CAST(CASE WHEN c.hash IS NULL THEN 0 ELSE 1 END + CASE WHEN f.hash IS NULL THEN 0 ELSE 1 END AS INTEGER) AS seen_count
    FROM c FULL JOIN f ON c.source = f.source AND c.key = f.key""",
)
def lifecycle_merge(spark, sf_dir):
    """One source's fetch is incomplete: its records stay untouched."""
    (orders,) = tab(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    rows = orders.groupBy(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("key"), old.alias("old")).agg(text.alias("text"), F.bool_or(F.col("o_orderstatus") == "P").alias("part")).withColumn("hash", F.md5("text"))
    seen = F.lit("1997-01-01").cast("timestamp_ntz")
    current = rows.where("old").select("source", "key", "hash", "text", F.lit("ok").alias("status"), seen.alias("first_seen"), seen.alias("last_seen"), F.when(F.col("key") % 4 == 0, F.lit("1997-06-01").cast("timestamp_ntz")).alias("expired_at"), F.lit(1).alias("seen_count"))
    snapshots = rows.where("NOT old").select("source", "key", "hash", "text", F.when(F.col("part"), "pending").otherwise("ok").alias("status"), (F.col("source") != "5-LOW").alias("complete"), F.lit(False).alias("unchanged"))
    fetched = L.usable(snapshots)
    return L.merge(current, fetched, fetched, as_of()).drop("text")


@query("q_incomplete_gate", "SELECT o_orderpriority AS source, count(*) AS rows, max(o_custkey) AS total, count(*) = max(o_custkey) AS complete FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1")
def incomplete_gate(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    pages = orders.where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01'").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("total"))
    return L.complete_pages(pages, ["source"])


def _polls(events):
    """Events read as polls of sources (users): errors fail, a quarter of these with 404; a zero value finds nothing."""
    ok = F.col("event_type") != "error"
    return events.select(F.col("user_id").cast("string").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("poll"), ok.alias("ok"), F.when(~ok & (F.col("event_id") % 4 == 0), 404).alias("code"), F.when(ok, F.floor(F.col("value") / 40)).alias("found"), F.col("value").alias("latency"))


@query(
    "q_board_state",
    """WITH RECURSIVE p AS (SELECT CAST(user_id AS VARCHAR) AS source, ts AS t, event_type <> 'error' AS ok, event_type = 'error' AND event_id % 4 = 0 AS gone, coalesce(floor(value / 40), 0) <> 0 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS k, 'live' AS status, 'B' AS tier, 0 AS failures, 0 AS not_found, CAST(NULL AS TIMESTAMP) AS empty_since FROM p
      UNION ALL
      SELECT f.source, p.k, CASE WHEN NOT ok THEN CASE WHEN gone AND not_found >= 1 THEN 'dead' WHEN failures >= 4 THEN 'failing' ELSE status END WHEN hit THEN 'live' WHEN t - coalesce(empty_since, t) >= INTERVAL 30 DAY THEN 'dormant' ELSE 'empty' END,
        CASE WHEN NOT ok THEN tier WHEN hit THEN 'B' WHEN t - coalesce(empty_since, t) >= INTERVAL 30 DAY THEN 'dormant' ELSE tier END, CASE WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN gone THEN not_found + 1 ELSE 0 END,
        CASE WHEN NOT ok THEN empty_since WHEN hit THEN NULL ELSE coalesce(empty_since, t) END
      FROM f JOIN p ON p.source = f.source AND p.k = f.k + 1)
    SELECT source, status, tier, failures, not_found, empty_since, k AS polls, CASE WHEN status = 'dead' THEN 604800 WHEN failures >= 5 THEN 21600 WHEN tier = 'A' THEN 900 WHEN tier = 'B' THEN 3600 ELSE 10800 END AS next_seconds
    FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC) = 1""",
)
def board_state(spark, sf_dir):
    """The state of every source after all its polls; the SQL walks them one by one."""
    (events,) = tab(spark, sf_dir, "events")
    states = L.source_states(_polls(events))
    return states.withColumn("next_seconds", L.next_interval(F.col("tier"), F.col("status"), F.col("failures")))


@query(
    "q_failure_streaks",
    """WITH p AS (SELECT event_id AS poll, CAST(user_id AS VARCHAR) AS source, ts, event_type <> 'error' AS ok FROM events), i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ts, poll ROWS UNBOUNDED PRECEDING) AS island FROM p)
    SELECT source, poll, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY source, island ORDER BY ts, poll ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM i""",
)
def failure_streaks(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    return L.failure_streaks(_polls(events)).select("source", "poll", "failures")


@query(
    "q_due_claim",
    """SELECT s_suppkey AS source, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier, greatest(900.0, 3 * 450000 / 1000.0)::DOUBLE AS lease_seconds FROM supplier
    WHERE s_acctbal <= 5000 AND (s_suppkey % 7 <> 0 OR s_nationkey <= 12) ORDER BY s_suppkey % 3, s_acctbal, s_suppkey LIMIT 30""",
)
def due_claim(spark, sf_dir):
    (supplier,) = tab(spark, sf_dir, "supplier")
    at = lambda seconds: F.expr(f"TIMESTAMP_NTZ '2001-08-01' + make_dt_interval(0, 0, 0, CAST({seconds} AS DECIMAL(18, 6)))")
    boards = supplier.select(
        F.col("s_suppkey").alias("source"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("tier"), F.when(F.col("s_suppkey") % 7 == 0, "dead").otherwise("live").alias("status"),
        at("s_acctbal - 5000").alias("next_poll_at"), at("(s_nationkey - 12) * 3600 - 604800").alias("last_seen"),
    )
    return L.claim_due(boards, as_of(), 30, F.lit(450000.0)).select("source", "tier", "lease_seconds")


@query("q_detail_cap", "SELECT l_suppkey, sum(CASE WHEN r <= 200 THEN 1 ELSE 0 END)::BIGINT AS detail, sum(CASE WHEN r > 200 THEN 1 ELSE 0 END)::BIGINT AS pending FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC) AS r FROM lineitem) GROUP BY 1")
def detail_cap(spark, sf_dir):
    (lineitem,) = tab(spark, sf_dir, "lineitem")
    chosen = L.choose_details(lineitem.select("l_suppkey", "l_shipdate"), ["l_suppkey"], [F.desc("l_shipdate")], 200)
    return chosen.groupBy("l_suppkey").agg(F.count_if(F.col("fetch") == "detail").alias("detail"), F.count_if(F.col("fetch") == "pending").alias("pending"))


@query("q_retry_backoff", "SELECT l_orderkey, l_partkey, least(21600, CAST(60 * pow(2, l_linenumber * 2) AS BIGINT)) AS delay_seconds FROM lineitem WHERE l_returnflag = 'R' AND (l_linenumber = 1 OR l_shipdate <= TIMESTAMP '1998-01-01')")
def retry_backoff(spark, sf_dir):
    (lineitem,) = tab(spark, sf_dir, "lineitem")
    pending = lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", (F.col("l_linenumber") * 2).alias("attempts"), F.when(F.col("l_linenumber") > 1, F.col("l_shipdate")).alias("next_attempt"))
    return L.retry_due(pending, F.lit("1998-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_partkey", "delay_seconds")


@query(
    "q_run_rollup",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS polls, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed, count(DISTINCT user_id) AS sources, CAST(coalesce(sum(CASE WHEN event_type <> 'error' THEN floor(value / 40) END), 0) AS BIGINT) AS found, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM events GROUP BY 1",
)
def run_rollup(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    return L.run_rollup(_polls(events).withColumn("day", F.to_date("at")), ["day"])


@query("q_active_jobs", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def active_jobs(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    jobs = orders.withColumn("status", F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded"))
    return L.reuse_active(jobs, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(
    "q_backfill_split",
    "SELECT CASE WHEN upper(text) <> text THEN 'changed' ELSE 'metadata' END AS kind, count(*) AS n FROM documents GROUP BY 1",
)
def backfill_split(spark, sf_dir):
    (documents,) = tab(spark, sf_dir, "documents")
    head = F.col("text")
    changed, metadata = L.split_backfill(documents.select("doc_id", F.sha2(head, 256).alias("hash"), F.lit(1).alias("version")), documents.select("doc_id", F.sha2(F.upper(head), 256).alias("hash"), F.lit(2).alias("version")), "doc_id")
    parts = changed.select(F.lit("changed").alias("kind")).unionByName(metadata.select(F.lit("metadata").alias("kind")))
    return parts.groupBy("kind").agg(F.count("*").alias("n"))




@query("q_backfill_resumed", "SELECT doc_id, sha256(coalesce(text, '')) AS hash, 2 AS version FROM documents")
def backfill_resumed(spark, sf_dir):
    """A pass over all texts that is stopped after two of its ranges and then goes on to the end."""
    (documents,) = tab(spark, sf_dir, "documents")
    top = scratch(spark, "backfill")
    work = lambda d: d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.lit(2).alias("version"))
    B.advance(documents, "doc_id", work, top, ranges=4, most=2)
    B.advance(documents, "doc_id", work, top, ranges=4)
    return B.result(spark, top)
