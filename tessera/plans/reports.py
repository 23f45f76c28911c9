"""Registered queries over lookups, facets, fact tables and the coverage report, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as P
from tessera.functions import text as T
from tessera.functions.expressions import computed
from tessera.operators import lifecycle as L
from tessera.operators import relational as R
from tessera.operators import reports as X
from tessera.operators.scoring import company_tier
from tessera.plans import postings as posts
from tessera.plans.registry import ORACLE_SQL, query
from tessera.plans.relational import as_of, tab

_list, _re = posts._sql_list, posts._sql
_pick = posts._pick


@query("q_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7 LIMIT 1")
def point_lookup(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    return X.point_lookup(orders, o_orderkey=7).select("o_orderkey", "o_custkey", "o_totalprice")


_CARDS = f"""c AS (SELECT o_orderkey AS id, {_list(posts.TITLES)}[o_orderkey % {len(posts.TITLES)} + 1] AS title, {_list(posts.COMPANIES)}[o_custkey % {len(posts.COMPANIES)} + 1] AS company, CASE WHEN o_orderkey % 9 > 0 THEN {_list(posts.PLACES)}[o_orderkey % {len(posts.PLACES)} + 1] END AS location,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS date_posted, b.bucket, s.salary FROM orders JOIN ({ORACLE_SQL['q_experience_buckets']}) b ON b.id = o_orderkey JOIN ({ORACLE_SQL['q_salary_extract']}) s ON s.id = o_orderkey)"""


def _cards(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    k, text = F.col("o_orderkey"), posts._text()
    rows = orders.select(
        k.alias("id"), _pick(posts.TITLES, "o_orderkey").alias("title"), _pick(posts.COMPANIES, "o_custkey").alias("company"), F.when(k % 9 > 0, _pick(posts.PLACES, "o_orderkey")).alias("location"), F.when(k % 5 > 0, F.col("o_orderdate")).alias("date_posted"),
        text.alias("text"), T.salary(text).alias("salary"),
    )
    # Filters ask for the bucket more than once; its patterns are tried once a row.
    return computed(rows, bucket=T.experience_bucket(T.experience_label(F.col("text")))).drop("text").withColumn("tier", company_tier(F.col("company")))


@query("q_facets", f"WITH {_CARDS} SELECT id, title, company FROM c WHERE bucket = 'early' AND contains(lower(company), 'o') AND contains(lower(concat_ws(' ', title, company, coalesce(location, ''))), 'engineer') AND salary <> '' AND date_trunc('day', date_posted) + INTERVAL 86399 SECOND >= TIMESTAMP '2001-08-01' - INTERVAL 2000 DAY")
def facets(spark, sf_dir):
    return X.facets(_cards(spark, sf_dir), as_of(), bucket="early", company=" O", keyword="Engineer", salary=True, days=2000).select("id", "title", "company")


@query("q_early_page", f"WITH {_CARDS} SELECT id, title, bucket FROM c WHERE (bucket = 'early' OR (bucket = 'unknown' AND regexp_matches(title, {_re(P.PAGE_NEW_GRAD)}))) AND NOT regexp_matches(title, {_re(P.PAGE_SENIOR_TITLE)}) AND NOT regexp_matches(title, {_re(P.PAGE_NON_TECH_TITLE)})")
def early_page(spark, sf_dir):
    cards = _cards(spark, sf_dir)
    return cards.where(X.early_career(F.col("title"), F.col("bucket"))).select("id", "title", "bucket")


@query("q_decision_counts", f"WITH {posts._DECIDED} SELECT 'category' AS kind, action AS name, count(*) AS n FROM d GROUP BY 2")
def decision_counts(spark, sf_dir):
    counts = X.category_counts(posts.decided(spark, sf_dir), "action", "reasons")
    return counts.where("kind = 'category'")


@query(
    "q_reason_counts",
    "SELECT kind, name, count(*) AS n FROM (SELECT 'category' AS kind, source AS name FROM documents UNION ALL SELECT 'reason', unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) = 3))) FROM documents) GROUP BY 1, 2",
)
def reason_counts(spark, sf_dir):
    """Documents by source, and by the three-letter words in them, each of which counts once a document."""
    (documents,) = tab(spark, sf_dir, "documents")
    words = F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) == 3)
    return X.category_counts(documents.select("source", words.alias("words")), "source", "words")


@query("q_route_averages", "SELECT event_type AS route, count(*) AS requests, count(*) FILTER (WHERE value > 100) AS errors, coalesce(round(avg(value), 2), 0.0) AS average FROM events GROUP BY 1")
def route_averages(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("requests"), F.count_if(F.col("value") > 100).alias("errors"), X.average(F.col("value")).alias("average"))


@query("q_first_candidate", "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, found FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 3 AS BIGINT) AS found FROM lineitem) WHERE found > 0 ORDER BY l_orderkey, l_linenumber, found DESC")
def first_candidate(spark, sf_dir):
    (lineitem,) = tab(spark, sf_dir, "lineitem")
    probes = lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3).alias("found"))
    return X.first_with_rows(probes, ["l_orderkey"], [F.asc("l_linenumber"), F.desc("found")], "found")


@query(
    "q_careers_urls",
    "SELECT c_custkey, CAST(n - 1 AS INTEGER) AS pos, replace(t[n], '{domain}', trim(lower(trim(' ' || replace(c_name, '#', '-') || '.COM/ ')), '/')) AS url FROM customer, (SELECT " + _list(P.CAREERS_TEMPLATES) + f" AS t), range(1, {len(P.CAREERS_TEMPLATES) + 1}) r(n)",
)
def careers_urls(spark, sf_dir):
    (customer,) = tab(spark, sf_dir, "customer")
    domain = F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(".COM/ "))
    return customer.select("c_custkey", F.posexplode(X.careers_urls(domain)).alias("pos", "url"))


@query(
    "q_requirement_refresh",
    f"""WITH v AS (SELECT o_custkey AS job, v.state, v.note, CASE o_orderkey % 3 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'VERIFIED' END AS old FROM ({ORACLE_SQL['q_requirement_verify']}) v JOIN orders ON id = o_orderkey)
    SELECT job, count(*) AS requirements, count(*) FILTER (WHERE NOT (old IS NOT DISTINCT FROM state AND note = '')) AS changed FROM v GROUP BY 1""",
)
def requirement_refresh(spark, sf_dir):
    """How many of the requirements of each posting (customer) changed their state or note."""
    (orders,) = tab(spark, sf_dir, "orders")
    at = lambda xs, key: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), F.expr(f"CAST({key} % {len(xs)} + 1 AS INT)"))
    old = F.when(F.col("o_orderkey") % 3 == 0, "REJECTED").when(F.col("o_orderkey") % 3 == 1, "VERIFIED")
    rows = orders.select(F.col("o_custkey").alias("job"), at([k for k, _ in posts.QUOTES], "o_orderkey").alias("kind"), at([q for _, q in posts.QUOTES], "o_orderkey").alias("quoted"), at(posts.QUOTED, "(o_orderkey div 7)").alias("posting"), old.alias("state"), F.lit("").alias("note"))
    return X.refreshed(rows).groupBy("job").agg(F.count("*").alias("requirements"), F.count_if("changed").alias("changed"))


@query(
    "q_fact_rows",
    """WITH f AS (SELECT p_brand AS project, p_size AS weight, p_partkey AS pos, coalesce(CASE p_partkey % 5 WHEN 0 THEN 'CONFLICTED' WHEN 1 THEN NULL ELSE 'ATTESTED' END, 'OBSERVED') AS tier, list_concat([{'key': 'project_fact', 'value': p_type}], list_transform(string_split(p_name, ' '), lambda t: {'key': 'skill', 'value': t})) AS x FROM part),
    r AS (SELECT project, weight, pos, tier, unnest(range(len(x))) AS nth, unnest(x) AS x FROM f WHERE tier <> 'CONFLICTED')
    SELECT project, key, value, tier, weight FROM (SELECT DISTINCT ON (project, x.key, lower(x.value)) project, x.key AS key, trim(x.value) AS value, tier, weight FROM r WHERE trim(x.value) <> '' ORDER BY project, x.key, lower(x.value), pos, nth)""",
)
def fact_rows(spark, sf_dir):
    (part,) = tab(spark, sf_dir, "part")
    tier = F.when(F.col("p_partkey") % 5 == 0, "CONFLICTED").when(F.col("p_partkey") % 5 > 1, "ATTESTED")
    return X.fact_rows(part.select(F.col("p_brand").alias("project"), F.col("p_size").alias("weight"), F.col("p_partkey").alias("pos"), tier.alias("tier"), F.col("p_type").alias("claim"), F.split("p_name", " ").alias("technologies")))


FACT_KEYS = ["skill", "Tools ", "skill:db", "target_role", "role:main", "degree", "education:ms", "citizenship", "location", "note"]
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(
    "q_profile_rows",
    f"""WITH f AS (SELECT p_brand AS owner, p_partkey AS id, {_list(FACT_KEYS)}[p_partkey % {len(FACT_KEYS)} + 1] AS key, CASE WHEN p_size % 6 > 0 THEN ' ' || p_type ELSE ' ' END AS value, CASE WHEN p_size % 2 = 0 THEN 'ATTESTED' ELSE 'OBSERVED' END AS tier, p_size % 7 - 2 AS weight FROM part), k AS (SELECT *, lower(trim(key)) AS k FROM f)
    SELECT owner, id, CASE WHEN k IN {_IN(P.SKILL_KEYS)} OR starts_with(k, 'skill:') THEN 'skills' WHEN k IN {_IN(P.ROLE_KEYS)} OR starts_with(k, 'role:') THEN 'preferred_roles' WHEN k IN {_IN(P.EDUCATION_KEYS)} OR starts_with(k, 'education:') THEN 'education' ELSE 'highlights' END AS section, trim(value) AS value, greatest(1, weight) AS weight
    FROM k WHERE trim(value) <> '' AND NOT (tier = 'ATTESTED' AND k IN {_IN(P.GATE_KEYS)})""",
)
def profile_rows(spark, sf_dir):
    (part,) = tab(spark, sf_dir, "part")
    size = F.col("p_size")
    facts = part.select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("id"), _pick(FACT_KEYS, "p_partkey").alias("key"), F.when(size % 6 > 0, F.concat(F.lit(" "), "p_type")).otherwise(" ").alias("value"), F.when(size % 2 == 0, "ATTESTED").otherwise("OBSERVED").alias("tier"), (size % 7 - 2).alias("weight"))
    return X.profile_rows(facts).select("owner", "id", "section", "value", "weight")


def _words(x: str, least: int, stop: list[str]) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(string_split_regex({x}, '\\s+'), lambda w: lower(trim(w, ',.()'))), lambda w: length(w) >= {least} AND NOT list_contains({_list(stop)}, w))))"


_HIGH, _TITLE = P.STOP_WORDS + P.GENERIC_TERMS, P.STOP_WORDS + P.GENERIC_TERMS + P.BROAD_TITLE_TERMS


@query("q_profile_keywords", f"SELECT doc_id, len(h) AS highlights, md5(array_to_string(h, ' ')) AS highlight_words, md5(array_to_string(t, ' ')) AS title_words FROM (SELECT doc_id, {_words('text', 5, _HIGH)} AS h, {_words('text', 3, _TITLE)} AS t FROM documents)")
def profile_keywords(spark, sf_dir):
    """The words of whole texts, read as highlights and as wanted roles."""
    (documents,) = tab(spark, sf_dir, "documents")
    words = documents.select("doc_id", F.array_sort(T.split_keywords(F.col("text"), _HIGH, 5)).alias("h"), F.array_sort(T.split_keywords(F.col("text"), _TITLE, 3)).alias("t"))
    return words.select("doc_id", F.size("h").cast("bigint").alias("highlights"), F.md5(F.array_join("h", " ")).alias("highlight_words"), F.md5(F.array_join("t", " ")).alias("title_words"))


INCLUDE, EXCLUDE = ["software engineer", "backend", "data engineer", "developer"], ["staff", "senior"]
_ANY = lambda words: " OR ".join(f"contains(lower(title), '{w}')" for w in words)


@query("q_source_titles", f"WITH {_CARDS} SELECT id, title FROM c WHERE ({_ANY(INCLUDE)}) AND NOT ({_ANY(EXCLUDE)})")
def source_titles(spark, sf_dir):
    """What a source is asked for by the titles to include and to leave out."""
    return _cards(spark, sf_dir).where(R.any_contains(["title"], INCLUDE) & ~R.any_contains(["title"], EXCLUDE)).select("id", "title")


_STATUS = f"{_list(L.RUN_STATUSES)}[event_id % {len(L.RUN_STATUSES)} + 1]"


@query(
    "q_run_counters",
    f"SELECT CAST(ts AS DATE) AS day, count(*) AS boards_polled, {', '.join(f"count(*) FILTER (WHERE {_STATUS} = '{s}') AS {s}" for s in L.RUN_STATUSES)}, {', '.join(f'CAST(sum(event_id % {i + 3}) AS BIGINT) AS {c}' for i, c in enumerate(L.RUN_SUMS))}, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) FILTER (WHERE value >= 0) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) FILTER (WHERE value >= 0) AS p95 FROM events GROUP BY 1",
)
def run_counters(spark, sf_dir):
    (events,) = tab(spark, sf_dir, "events")
    polls = events.select(F.to_date("ts").alias("day"), _pick(L.RUN_STATUSES, "event_id").alias("status"), F.col("value").alias("latency"), *[(F.col("event_id") % (i + 3)).alias(c) for i, c in enumerate(L.RUN_SUMS)])
    return L.run_counters(polls, ["day"])


STATES, TIMED = ["detected", "not_found", "error", "unsupported", "detected"], ["1-URGENT", "5-LOW"]
_NOW = "TIMESTAMP '2001-08-01'"
_PCT = lambda part, of: f"round(100.0 * count(*) FILTER (WHERE {part}) / greatest({of}, 1), 2)"


def _section(section: str, rows: str, key: str, metrics: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {key} AS key, '{m}' AS metric, CAST({v} AS DOUBLE) AS value {rows}" for m, v in metrics)


_COUNT = lambda cond: f"count(*) FILTER (WHERE {cond})"
_COVERAGE = " UNION ALL ".join([
    _section("registry", "FROM g", "''", [("total", "count(*)"), ("detected", _COUNT("status = 'detected'")), ("verified", _COUNT("status = 'detected' AND confidence = 'high'")), ("low_confidence", _COUNT("confidence = 'low'")), ("not_found", _COUNT("status = 'not_found'")), ("error", _COUNT("status = 'error'")), ("linked", "count(board_id)")]),
    _section("registry_by_ats", "FROM g GROUP BY ats, status", "coalesce(ats, 'none') || '|' || status", [("companies", "count(*)")]),
    _section("unsupported_ats", "FROM g WHERE status = 'unsupported' GROUP BY ats", "coalesce(ats, 'none')", [("companies", "count(*)")]),
    _section("boards", "FROM b GROUP BY ats, status, tier", "ats || '|' || status || '|' || tier", [("boards", "count(*)")]),
    _section("active_jobs", "FROM j WHERE expired_at IS NULL GROUP BY source", "source", [("jobs", "count(*)")]),
    _section("new_jobs", "FROM j GROUP BY source", "source", [("last_1h", _COUNT(f"first_seen >= {_NOW} - INTERVAL 1 HOUR")), ("last_24h", _COUNT(f"first_seen >= {_NOW} - INTERVAL 24 HOUR")), ("last_7d", _COUNT(f"first_seen >= {_NOW} - INTERVAL 7 DAY"))]),
    _section("description_quality", "FROM j WHERE expired_at IS NULL GROUP BY source", "source", [("pct_empty", _PCT("coalesce(text, '') = ''", "count(*)")), ("pct_lt_200", _PCT("length(coalesce(text, '')) < 200", "count(*)")), ("pct_with_heading", _PCT("contains(text, '## ')", "count(*)")), ("pct_leftover_markup", _PCT(f"regexp_matches(coalesce(text, ''), {_re(P.LEFTOVER_MARKUP, '')})", "count(*)"))]),
    _section("freshness", f"FROM j WHERE source IN {_IN(TIMED)} AND date_posted IS NOT NULL GROUP BY source", "source", [("p50_minutes", "quantile_cont(date_diff('second', date_posted, first_seen) / 60.0::DOUBLE, 0.5)"), ("p95_minutes", "quantile_cont(date_diff('second', date_posted, first_seen) / 60.0::DOUBLE, 0.95)")]),
    _section("expired_jobs", "FROM j", "''", [("last_24h", _COUNT(f"expired_at >= {_NOW} - INTERVAL 24 HOUR")), ("last_7d", _COUNT(f"expired_at >= {_NOW} - INTERVAL 7 DAY"))]),
    _section("sweep_health", "FROM r", "''", [("p50", "p50"), ("p95", "p95"), ("due", "due"), ("polled", "polled"), ("pct_polled", "round(100.0 * polled / greatest(due, 1), 2)")]),
    _section("schedule", "FROM b WHERE status <> 'dead'", "''", [("non_dead", "count(*)"), ("due", _COUNT(f"next_poll_at <= {_NOW}")), ("lagged_over_20m", _COUNT(f"next_poll_at < {_NOW} - INTERVAL 20 MINUTE")), ("pct_on_schedule", _PCT(f"next_poll_at >= {_NOW} - INTERVAL 20 MINUTE", "count(*)"))]),
    _section("top_companies", "FROM (SELECT company, source, count(*) AS n FROM j WHERE expired_at IS NULL GROUP BY 1, 2 ORDER BY n DESC, company, source LIMIT 50)", "company || '|' || source", [("active_jobs", "n")]),
])


@query(
    "q_coverage_report",
    f"""WITH {posts._POSTINGS}, g AS (SELECT CASE WHEN p_size % 7 > 0 THEN p_brand END AS ats, {_list(STATES)}[p_partkey % {len(STATES)} + 1] AS status, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS confidence, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS board_id FROM part),
    b AS (SELECT CAST(s_nationkey AS VARCHAR) AS ats, CASE WHEN s_suppkey % 7 = 0 THEN 'dead' ELSE 'live' END AS status, ['A', 'B', 'C'][s_suppkey % 3 + 1] AS tier, {_NOW} + to_minutes(s_suppkey % 60 - 30) AS next_poll_at FROM supplier),
    j AS (SELECT o_orderpriority AS source, 'c' || (o_custkey % 40) AS company, o_orderdate AS first_seen, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate - to_hours(o_orderkey % 96) END AS date_posted, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS expired_at, CASE WHEN o_orderkey % 3 = 0 THEN '## <b>' || text ELSE text END AS text FROM orders JOIN p ON p.id = o_orderkey),
    r AS (SELECT o_totalprice AS p50, 2 * o_totalprice AS p95, o_custkey AS due, o_custkey - o_custkey % 9 AS polled FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
    {_COVERAGE}""",
)
def coverage_report(spark, sf_dir):
    """All twelve sections over whole tables."""
    part, supplier, orders = tab(spark, sf_dir, "part", "supplier", "orders")
    k, day = F.col("p_partkey"), F.col("o_orderdate")
    registry = part.select(F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).alias("ats"), _pick(STATES, "p_partkey").alias("status"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "low").alias("confidence"), F.when(k % 2 == 0, k).alias("board_id"))
    boards = supplier.select(F.col("s_nationkey").cast("string").alias("ats"), F.when(F.col("s_suppkey") % 7 == 0, "dead").otherwise("live").alias("status"), _pick(["A", "B", "C"], "s_suppkey").alias("tier"), (as_of() + F.make_dt_interval(mins=(F.col("s_suppkey") % 60 - 30).cast("int"))).alias("next_poll_at"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("## <b>"), posts._text())).otherwise(posts._text())
    jobs = orders.select(
        F.col("o_orderpriority").alias("source"), F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("company"), day.alias("first_seen"), F.when(F.col("o_orderkey") % 4 > 0, day - F.make_dt_interval(hours=(F.col("o_orderkey") % 96).cast("int"))).alias("date_posted"),
        F.when(F.col("o_orderstatus") == "F", day + F.expr("INTERVAL 3 DAYS")).alias("expired_at"), text.alias("text"),
    )
    price, due = F.col("o_totalprice"), F.col("o_custkey")
    runs = orders.select(F.col("o_orderkey").alias("run_id"), day.alias("started_at"), F.when(F.col("o_orderstatus") != "P", day).alias("finished_at"), price.alias("p50"), (2 * price).alias("p95"), due.alias("due"), (due - due % 9).alias("polled"))
    return X.coverage_report(registry, boards, jobs, runs, as_of(), TIMED)
