"""Registered queries over the relational and aggregating operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import relational as R
from tessera.operators.selection import beside, quantiles
from tessera.operators.vectors import best_answers, scoped
from tessera.plans.registry import query


def as_of():
    """The clock of the order tables."""
    return F.lit("2001-08-01").cast("timestamp_ntz")


def events_as_of():
    """The clock of the event table."""
    return F.lit("2024-01-31").cast("timestamp_ntz")


def tab(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


@query("q_browse_page", "SELECT *, count(*) OVER () = 20 AS has_more FROM (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40)")
def browse_page(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    found = R.optional_filters(orders, o_orderstatus="O", o_orderpriority=None).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return R.page(found, [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")], 40, 20)


@query("q_status_join", "SELECT o_orderkey, o_orderstatus, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def status_join(spark, sf_dir):
    orders, customer = tab(spark, sf_dir, "orders", "customer")
    return orders.where("o_orderpriority = '1-URGENT'").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "c_name", "c_mktsegment")


@query(
    "q_or_join",
    "SELECT DISTINCT ON (s.s_suppkey) s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey % 5 = n.n_regionkey AND (s.s_nationkey = n.n_nationkey OR n.n_name = 'NATION_0') ORDER BY s.s_suppkey, n.n_name",
)
def or_join(spark, sf_dir):
    supplier, nation = tab(spark, sf_dir, "supplier", "nation")
    both = supplier.join(nation, (F.col("s_nationkey") % 5 == F.col("n_regionkey")) & ((F.col("s_nationkey") == F.col("n_nationkey")) | (F.col("n_name") == "NATION_0")))
    return R.first_per_group(both, ["s_suppkey"], [F.asc("n_name")]).select("s_suppkey", "n_name")


@query(
    "q_stale_or_missing",
    "SELECT c_custkey, c_name, d.v AS done_version FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey % 7) AS v FROM orders WHERE o_totalprice > 200000 GROUP BY 1) d ON o_custkey = c_custkey WHERE d.v IS NULL OR d.v < 3",
)
def stale_or_missing(spark, sf_dir):
    customer, orders = tab(spark, sf_dir, "customer", "orders")
    done = orders.where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderkey") % 7).alias("v")).withColumn("wanted_version", F.lit(3))
    return R.missing_or_stale(customer.select("c_custkey", "c_name"), done, "c_custkey", F.col("v"))


@query(
    "q_lateral_top1",
    "SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) o ON true",
)
def lateral_top1(spark, sf_dir):
    customer, orders = tab(spark, sf_dir, "customer", "orders")
    held = orders.where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return R.best_match(customer.select("c_custkey"), held, ["c_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("q_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS LAST, o_orderkey")
def distinct_on(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    return R.first_per_group(orders, ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("q_top_n_per_group", "SELECT * FROM (SELECT l_returnflag, l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rank_in_group FROM lineitem) WHERE rank_in_group <= 5")
def top_n_per_group(spark, sf_dir):
    (lineitem,) = tab(spark, sf_dir, "lineitem")
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return R.first_per_group(lineitem, ["l_returnflag"], [F.desc("l_extendedprice"), *map(F.asc, ids)], 5).select("l_returnflag", *ids, "rank_in_group")


@query("q_fresh_queue", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT DISTINCT ON (o_custkey) * FROM orders WHERE o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 120 DAY ORDER BY o_custkey, o_orderdate DESC, o_orderkey) ORDER BY o_custkey LIMIT 50")
def fresh_queue(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    recent = orders.where(F.col("o_orderdate") > as_of() - F.expr("INTERVAL 120 DAY"))
    return R.first_per_group(recent, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).orderBy("o_custkey").limit(50).select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "q_retention_anti",
    "SELECT c_custkey FROM customer WHERE NOT (EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 90 DAY) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000))",
)
def retention_anti(spark, sf_dir):
    customer, orders = tab(spark, sf_dir, "customer", "orders")
    swept = orders.where("o_orderstatus = 'F'").limit(1).agg((F.count("*") > 0).alias("swept"))
    guarded = customer.select("c_custkey").crossJoin(F.broadcast(swept))
    recent = orders.where(F.col("o_orderdate") > as_of() - F.expr("INTERVAL 90 DAY"))
    return R.retain(guarded, F.col("swept"), [(recent, "o_custkey"), (orders.where("o_totalprice > 400000"), "o_custkey")], "c_custkey").select("c_custkey")


@query(
    "q_join_update_tiers",
    """WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY n DESC, s_suppkey) AS rank FROM (SELECT s_suppkey, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1))
    SELECT s_suppkey, CASE WHEN rank <= 10 THEN 'A' WHEN rank <= 40 THEN 'B' ELSE 'C' END AS band FROM r""",
)
def join_update_tiers(spark, sf_dir):
    supplier, lineitem = tab(spark, sf_dir, "supplier", "lineitem")
    n = lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    ranked = supplier.select("s_suppkey").join(n, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))
    # the second band counts from the top of the whole ranking, less the first band
    return R.assign_bands(ranked, [F.desc("n"), F.asc("s_suppkey")], [("A", 1, 10), ("B", 1, 40)], "C").select("s_suppkey", "band")


@query("q_group_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2")
def group_counts(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    return orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query(
    "q_filtered_counts",
    "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50 AND user_id % 2 = 0) AS low_even, CAST(round(100.0 * count(*) FILTER (WHERE value > 50) / greatest(count(*), 1), 2) AS DOUBLE) AS high_pct FROM events GROUP BY 1",
)
def filtered_counts(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    v = F.col("value")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v > 50).alias("high"), F.count_if((v <= 50) & (F.col("user_id") % 2 == 0)).alias("low_even"), A.percent(v > 50).alias("high_pct"))


@query("q_percent_or_null", "SELECT CAST(round(100.0 * count(*) FILTER (WHERE quality = 1) / nullif(count(*), 0), 2) AS DOUBLE) AS good_pct, CAST(round(100.0 * count(*) FILTER (WHERE toxic = 1) / nullif(count(*), 0), 2) AS DOUBLE) AS toxic_pct FROM labels")
def percent_null(spark, sf_dir):
    (labels,) = tab(spark, sf_dir, "labels")
    return labels.agg(A.percent_or_null(F.col("quality") == 1).alias("good_pct"), A.percent_or_null(F.col("toxic") == 1).alias("toxic_pct"))


@query("q_table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, sf_dir):
    parts = [d.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, d in zip(("orders", "customer", "events"), tab(spark, sf_dir, "orders", "customer", "events"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_GAP = "epoch_us(l_shipdate) - epoch_us(o_orderdate)"


@query(
    "q_freshness_percentiles",
    f"SELECT l_returnflag, round(quantile_cont(({_GAP}) / 6e7, 0.5), 6) AS p50, round(quantile_cont(({_GAP}) / 6e7, 0.95), 6) AS p95 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def freshness_percentiles(spark, sf_dir):
    orders, lineitem = tab(spark, sf_dir, "orders", "lineitem")
    gap = F.timestamp_diff("MICROSECOND", F.col("o_orderdate"), F.col("l_shipdate")) / 6e7
    both = orders.select("o_orderkey", "o_orderdate").join(lineitem.select("l_orderkey", "l_returnflag", "l_shipdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = quantiles(both, ["l_returnflag"], gap, {"p50": ("continuous", 0.5), "p95": ("continuous", 0.95)})
    return found.select("l_returnflag", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    "q_nearest_rank",
    "SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) FILTER (WHERE value >= 0) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) FILTER (WHERE value >= 0) AS p95, list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS by_index FROM events GROUP BY 1",
)
def nearest_rank(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    value = F.col("value")
    measured = quantiles(events, ["event_type"], F.when(value >= 0, value), {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95)})
    return beside(quantiles(events, ["event_type"], value, {"by_index": ("index", 0.95)}), ["event_type"], measured).select("event_type", "p50", "p95", "by_index")


@query(
    "q_rolling_windows",
    "SELECT event_type, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS last_week FROM events WHERE ts <= TIMESTAMP '2024-01-31' GROUP BY 1",
)
def rolling_windows(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    since = lambda span: F.count_if(F.col("ts") > events_as_of() - F.expr(f"INTERVAL {span}"))
    return events.where(F.col("ts") <= events_as_of()).groupBy("event_type").agg(since("1 HOUR").alias("last_hour"), since("24 HOUR").alias("last_day"), since("7 DAY").alias("last_week"))


@query("q_ring_buffer", "SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS BIGINT) AS errors_50 FROM events")
def ring_buffer(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    keyed = events.withColumn("at", F.struct("ts", "event_id"))
    return keyed.select("event_id", "user_id", A.rolling((F.col("event_type") == "error").cast("long"), ["user_id"], "at", 50).alias("errors_50"))


@query(
    "q_topk_values",
    """WITH c AS (SELECT c_mktsegment, n_name, count(*) AS n, min(c_custkey) AS first_at FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, first_at) AS r FROM c)
    SELECT c_mktsegment, list(n_name ORDER BY r) AS top_values FROM r WHERE r <= 8 GROUP BY 1""",
)
def topk_values(spark, sf_dir):
    customer, nation = tab(spark, sf_dir, "customer", "nation")
    return A.top_values(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), ["c_mktsegment"], "n_name", "c_custkey", 8)


@query(
    "q_health_snapshot",
    "SELECT (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-30') AS recent, (SELECT CAST(round(count(*) FILTER (WHERE event_type <> 'error') * 1.0 / greatest(count(*), 1), 6) AS DOUBLE) FROM events WHERE ts > TIMESTAMP '2024-01-30') AS ok_rate, (SELECT max(o_orderdate) FROM orders) AS newest",
)
def health_snapshot(spark, sf_dir):
    events, orders = tab(spark, sf_dir, "events", "orders")
    ok = F.round(F.count_if(F.col("event_type") != "error") / F.greatest(F.count("*"), F.lit(1)), 6).cast("double")
    a = events.where("ts > TIMESTAMP_NTZ '2024-01-30'").agg(F.count("*").alias("recent"), ok.alias("ok_rate"))
    return a.crossJoin(orders.agg(F.max("o_orderdate").alias("newest")))


@query(
    "q_span_sum",
    "SELECT o_custkey, round(sum(greatest(date_diff('day', CAST(s AS DATE), CAST(e AS DATE)), 0)) / 365.25, 2) AS years FROM (SELECT o_custkey, o_orderpriority, min(o_orderdate) AS s, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END), TIMESTAMP '2001-08-01') AS e FROM orders GROUP BY 1, 2) GROUP BY 1",
)
def span_sum(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    spans = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("s"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("e"))
    return spans.groupBy("o_custkey").agg(A.years_between(F.col("s"), F.col("e"), as_of()).alias("years"))


@query("q_set_hash", "SELECT l_orderkey, sha256(string_agg(x, chr(10) ORDER BY x)) AS set_hash FROM (SELECT l_orderkey, concat_ws('|', l_partkey, l_suppkey, l_linenumber, l_returnflag) AS x FROM lineitem) GROUP BY 1")
def set_hash(spark, sf_dir):
    (lineitem,) = tab(spark, sf_dir, "lineitem")
    return lineitem.groupBy("l_orderkey").agg(A.set_hash(*map(F.col, ("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"))).alias("set_hash"))


@query(
    "q_pivot_facts",
    "SELECT user_id, string_agg(event_type || '=' || event_id, ',' ORDER BY event_type) AS facts FROM (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC) GROUP BY 1",
)
def pivot_facts(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    facts = A.last_wins(events, ["user_id"], "event_type", "event_id", [F.desc("ts"), F.desc("event_id")])
    return facts.select("user_id", F.array_join(F.transform(F.map_entries("facts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("facts"))


@query(
    "q_upsert",
    """WITH c AS (SELECT o_custkey AS k, max(o_orderkey) AS last_order, 1 AS seen FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), i AS (SELECT o_custkey AS k, max(o_orderkey) AS last_order FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority = '2-HIGH' GROUP BY 1)
    SELECT coalesce(c.k, i.k) AS k, CASE WHEN i.k IS NULL THEN c.last_order ELSE i.last_order END AS last_order, CASE WHEN c.k IS NULL THEN 1 WHEN i.k IS NULL THEN c.seen ELSE c.seen + 1 END AS seen FROM c FULL JOIN i ON c.k = i.k""",
)
def upsert(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    split = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    last = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("last_order"))
    current = last(orders.where(split)).withColumn("seen", F.lit(1))
    incoming = last(orders.where(~split & (F.col("o_orderpriority") == "2-HIGH")))
    return R.upsert(current, incoming, "k", {"last_order": F.col("i.last_order"), "seen": F.col("c.seen") + 1}, {"last_order": F.col("i.last_order"), "seen": F.lit(1)})


@query(
    "q_insert_absent",
    "SELECT DISTINCT ON (k) k, p_partkey FROM (SELECT lower(trim(p_brand)) || '-' || p_size AS k, p_partkey FROM part WHERE p_partkey % 3 <> 0) WHERE k NOT IN (SELECT lower(trim(p_brand)) || '-' || p_size FROM part WHERE p_partkey % 3 = 0) ORDER BY k, p_partkey",
)
def insert_absent(spark, sf_dir):
    (part,) = tab(spark, sf_dir, "part")
    keyed = part.select(F.concat_ws("-", F.lower(F.trim("p_brand")), "p_size").alias("k"), "p_partkey")
    return R.insert_absent(keyed.where("p_partkey % 3 = 0"), keyed.where("p_partkey % 3 <> 0"), "k", [F.asc("p_partkey")])


@query(
    "q_import_outcome",
    "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c.o_custkey IS NULL THEN 'inserted' WHEN c.p IS NOT DISTINCT FROM i.p THEN 'skipped' ELSE 'updated' END AS outcome FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) i LEFT JOIN (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) c ON i.o_custkey = c.o_custkey) GROUP BY 1",
)
def import_outcome(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    sets = lambda cond: orders.where(cond).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    found = R.classify_import(sets("o_orderdate < TIMESTAMP_NTZ '1996-01-01'"), sets("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'"), "o_custkey", ["p"])
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "q_version_bump",
    "SELECT i.c_custkey, i.c_acctbal, coalesce(i.seg, c.seg) AS seg, coalesce(c.version, 0) + 1 AS version FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS seg FROM customer) i LEFT JOIN (SELECT c_custkey, c_mktsegment AS seg, CAST(c_custkey % 5 AS BIGINT) AS version FROM customer WHERE c_acctbal > 2000) c ON c.c_custkey = i.c_custkey",
)
def version_bump(spark, sf_dir):
    (customer,) = tab(spark, sf_dir, "customer")
    current = customer.where("c_acctbal > 2000").select("c_custkey", F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") % 5).alias("version"))
    incoming = customer.select("c_custkey", "c_acctbal", F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END").alias("seg"))
    return R.bump_version(current, incoming, "c_custkey", ["seg"])


_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{4,}}'))"


@query(
    "q_token_overlap",
    f"""WITH b AS (SELECT item_id, unnest({_TOKENS.format("text")}) AS token FROM benchmark), d AS (SELECT doc_id, unnest({_TOKENS.format("text")}) AS token FROM documents),
    h AS (SELECT item_id, doc_id, count(*) AS overlap FROM b JOIN d USING (token) GROUP BY 1, 2)
    SELECT item_id, doc_id, overlap, rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank_in_group FROM h) WHERE rank_in_group <= 10""",
)
def token_overlap(spark, sf_dir):
    benchmark, documents = tab(spark, sf_dir, "benchmark", "documents")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0)).alias("tokens")
    return R.token_overlap(benchmark.select("item_id", tokens), documents.select("doc_id", tokens), "item_id", "doc_id")


#: The vectors of the table are random ones, of which no two reach the threshold that answers are held to; this one parts them.
LIKE_ENOUGH = 0.3
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(
    "q_vector_best",
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 20 = 0), a AS (SELECT vec_id, embedding, CASE WHEN vec_id % 7 > 0 THEN label END AS scope FROM embeddings),
    s AS (SELECT query_id, vec_id, round({_DOT.format("qe", "embedding")} / (sqrt({_DOT.format("qe", "qe")}) * sqrt({_DOT.format("embedding", "embedding")})), 6) AS cosine FROM q JOIN a ON coalesce(scope, ql) = ql AND vec_id <> query_id)
    SELECT * FROM (SELECT DISTINCT ON (query_id) query_id, vec_id, cosine FROM s ORDER BY query_id, cosine DESC, vec_id) WHERE cosine >= {LIKE_ENOUGH}""",
)
def vector_best(spark, sf_dir):
    """Each question's best answer of its own scope or of none, if it is like enough."""
    (embeddings,) = tab(spark, sf_dir, "embeddings")
    label, k = F.col("label"), F.col("vec_id")
    found = best_answers(scoped(embeddings.where("vec_id % 20 = 0"), "vec_id", label, "embedding"), scoped(embeddings, "vec_id", F.when(k % 7 > 0, label), "embedding"), LIKE_ENOUGH)
    return found.withColumnRenamed("id", "vec_id")


@query("q_json_explode", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def json_explode(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    parsed = events.select("event_type", F.explode(F.array(F.from_json("props", "struct<k:bigint>"))).alias("p"))
    return parsed.where("p.k is not null").groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@query("q_top_k", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25")
def top_k(spark, sf_dir):
    (part,) = tab(spark, sf_dir, "part")
    return part.select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(25)
