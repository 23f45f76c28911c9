"""Registered queries over rule cascades, scores and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import scoring as S
from tessera.plans.registry import query
from tessera.plans.relational import as_of, tab

# Titles, companies and places dealt to orders by key, so that every rule meets rows in bulk.
TITLES = ["Software Engineer", "Senior Backend Engineer", "Sales Engineer", "New Grad Software Engineer", "Mechanical Engineer", "Data Scientist", "Staff Platform Engineer", "Software Engineer, Top Secret Clearance", "Lead Software Engineer - Entry Level", "Nurse", "SDE II", "Engineering Manager"]
PLACES = ["Seattle, WA", "Remote - US", "London", "Bengaluru, India", "Austin, TX, USA", "Toronto", "New York, NY", "Prague, Czech Republic"]
COMPANIES = ["stripe", "anduril", "openai", "acme", "amazon", "spacex", "corner shop"]


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _jobs(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    title = F.when(F.col("o_orderkey") % 97 == 0, F.lit(None)).otherwise(_pick(TITLES, "o_orderkey"))
    place = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(_pick(PLACES, "o_orderkey"))
    return orders.select(F.col("o_orderkey").alias("job_id"), title.alias("title"), _pick(COMPANIES, "o_custkey").alias("company"), place.alias("location"), F.col("o_orderdate").alias("date_posted"), F.col("o_orderdate").alias("first_seen"))


_ARR = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_Q = lambda p: "'(?i)" + p.replace("'", "''") + "'"
_JOBS = f"""j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {_ARR(TITLES)}[o_orderkey % {len(TITLES)} + 1] END AS title, {_ARR(COMPANIES)}[o_custkey % {len(COMPANIES)} + 1] AS company,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {_ARR(PLACES)}[o_orderkey % {len(PLACES)} + 1] END AS location, o_orderdate AS date_posted FROM orders)"""
_F = S.TITLE_FILTERS["v3"]
_HIT = lambda x, p: f"coalesce(regexp_matches({x}, {_Q(p)}), false)"


@query(
    "q_title_filter",
    f"""WITH {_JOBS}, r AS (SELECT *, CASE WHEN {_HIT("title", S.P.ROLE_HEAD)} THEN 'role_head' WHEN {_HIT("title", S.P.WRONG_DISCIPLINE)} THEN 'wrong_discipline' WHEN {_HIT("title", _F.seniority)} AND NOT {_HIT("title", _F.exempt)} THEN 'seniority' WHEN {_HIT("title", _F.clearance)} THEN 'clearance_title' WHEN NOT {_HIT("title", _F.swe_title)} THEN 'no_title_match' END AS before FROM j),
    s AS (SELECT *, coalesce(before, CASE WHEN date_posted < TIMESTAMP '2001-08-01' - INTERVAL 30 DAY THEN 'stale_posting' WHEN NOT regexp_matches(location, {_Q(_F.located)}) THEN 'non_us_location' END) AS reason FROM r)
    SELECT job_id, reason IS NULL AS eligible, reason AS skip_reason, CASE WHEN before IS NULL THEN 'swe_title' END AS matched_pattern, 3 AS filter_version FROM s""",
)
def title_filter(spark, sf_dir):
    return S.filter_titles(_jobs(spark, sf_dir), "v3", as_of()).select("job_id", "eligible", "skip_reason", "matched_pattern", "filter_version")


@query("q_filter_review", "SELECT title, count(*) AS n FROM (SELECT " + _ARR(TITLES) + f"[o_orderkey % {len(TITLES)} + 1] AS title FROM orders WHERE o_orderkey % 97 <> 0) WHERE regexp_matches(title, {_Q(S.P.ROLE_HEAD)}) OR regexp_matches(title, {_Q(S.P.WRONG_DISCIPLINE)}) GROUP BY 1")
def filter_review(spark, sf_dir):
    found = S.filter_titles(_jobs(spark, sf_dir), "v1", as_of())
    return found.where(F.col("skip_reason").isin("role_head", "wrong_discipline")).groupBy("title").agg(F.count("*").alias("n"))


_KW = ["steel", "brass", "copper", "widget"]


@query(
    "q_keyword_score",
    f"SELECT p_partkey, score, CASE WHEN hits > 0 THEN least(100, 15 * hits) ELSE 5 END AS fallback FROM (SELECT p_partkey, CAST(list_sum(list_transform({_ARR(_KW)}, lambda w: CASE WHEN contains(lower(p_name), w) THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_type), w) THEN 1 ELSE 0 END)) AS INTEGER) AS score, len(list_filter({_ARR(_KW)}, lambda w: contains(lower(p_name || ' ' || p_type), w)))::INTEGER AS hits FROM part) WHERE score >= 3 OR hits = 0",
)
def keyword_score(spark, sf_dir):
    (part,) = tab(spark, sf_dir, "part")
    words = F.array(*map(F.lit, _KW))
    both = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    rows = part.select("p_partkey", T.keyword_score(words, F.col("p_name"), F.col("p_type")).alias("score"), F.size(F.filter(words, lambda w: both.contains(w))).alias("hits"))
    return rows.where("score >= 3 OR hits = 0").select("p_partkey", "score", S.fallback_score(F.col("hits")).alias("fallback"))


_NOW = "TIMESTAMP '2001-08-01'"


@query(
    "q_action_score",
    f"""WITH {_JOBS}, h AS (SELECT *, coalesce(title, '') AS t, greatest((epoch_us({_NOW}) - epoch_us(date_posted)) / 3.6e9, 0) AS hours, greatest(floor((epoch_us({_NOW}) - epoch_us(date_posted)) / 8.64e10), 0) AS days, concat_ws(' ', company, title, location) AS blob FROM j)
    SELECT job_id, CAST(CASE WHEN {_HIT("t", S.P.QUEUE_EARLY)} THEN 55 ELSE 0 END + CASE WHEN {_HIT("t", S.P.QUEUE_JUNIOR_LEVEL)} THEN 35 ELSE 0 END + CASE WHEN {_HIT("t", S.P.QUEUE_SENIOR)} THEN -30 ELSE 18 END + CASE WHEN hours <= 2 THEN 30 WHEN hours <= 24 THEN 20 WHEN hours <= 72 THEN 10 ELSE 0 END
      + CASE WHEN days <= 1 THEN 15 WHEN days <= 7 THEN 8 WHEN days > 30 THEN -20 ELSE 0 END + CASE WHEN {_HIT("location", S.P.QUEUE_REMOTE_US)} THEN 8 ELSE 0 END + CASE WHEN {_HIT("company", S.P.QUEUE_DEFENSE_COMPANY)} OR {_HIT("blob", S.P.QUEUE_DEFENSE)} THEN -140 ELSE 0 END + CASE WHEN {_HIT("company", S.P.QUEUE_OUTREACH_COMPANY)} THEN 12 ELSE 0 END AS INTEGER) AS score,
      CAST(CASE WHEN {_HIT("company", S.P.QUEUE_OUTREACH_COMPANY)} THEN 35 ELSE 0 END + CASE WHEN {_HIT("t", S.P.QUEUE_EARLY)} OR {_HIT("t", S.P.QUEUE_JUNIOR_LEVEL)} THEN 25 ELSE 0 END + CASE WHEN {_HIT("t", S.P.QUEUE_SENIOR)} THEN 0 ELSE 10 END + CASE WHEN {_HIT("company", S.P.QUEUE_DEFENSE_COMPANY)} OR {_HIT("blob", S.P.QUEUE_DEFENSE)} THEN -100 ELSE 0 END AS INTEGER) AS outreach FROM h""",
)
def action_score(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    args = [F.col(c) for c in ("company", "title", "location")]
    return jobs.select("job_id", S.action_score(*args, F.col("date_posted"), F.col("first_seen"), as_of())[0].alias("score"), S.outreach_score(*args)[0].alias("outreach"))


#: What postings say of sponsorship, dealt to companies; where a company says both, no holds.
SPONSORING = ["Visa sponsorship is offered.", "We are unable to sponsor.", None, "CPT and options.", "H-1B transfers; no sponsorship after.", "", "Optional perks."]
_POINTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.P.SPONSOR_POINTS.items())


@query(
    "q_company_signals",
    f"""WITH {_JOBS}, d AS (SELECT j.*, concat_ws(' ', coalesce(title, ''), coalesce([{', '.join('NULL' if x is None else f"'{x}'" for x in SPONSORING)}][CASE company WHEN 'acme' THEN 1 WHEN 'amazon' THEN 3 ELSE job_id % {len(SPONSORING)} + 1 END], '')) AS blob FROM j),
    g AS (SELECT company, count(*) AS open_jobs, count(*) FILTER (WHERE {_HIT("blob", S.P.NEW_GRAD)}) AS new_grad_jobs, count(*) FILTER (WHERE {_HIT("blob", S.P.SOFTWARE)} AND job_id % 5 <> 0) AS matching_jobs, max(date_posted) AS last_verified_at,
      CASE WHEN bool_or({_HIT("blob", S.P.SPONSOR_NO)}) THEN 'no' WHEN bool_or({_HIT("blob", S.P.SPONSOR_YES)}) THEN 'yes' ELSE 'unknown' END AS sponsorship FROM d GROUP BY 1)
    SELECT *, CAST(greatest(0, least(100, least(8 * matching_jobs, 40) + least(10 * new_grad_jobs, 20) + CASE sponsorship {_POINTS} ELSE 0 END - 15 + 4)) AS INTEGER) AS quality FROM g""",
)
def company_signals(spark, sf_dir):
    at = F.when(F.col("company") == "acme", 1).when(F.col("company") == "amazon", 3).otherwise(F.col("job_id") % len(SPONSORING) + 1)
    said = F.element_at(F.array(*map(F.lit, SPONSORING)), at.cast("int"))
    jobs = _jobs(spark, sf_dir).withColumns({"description_text": said, "eligible": F.when(F.col("job_id") % 5 == 0, False), "last_verified_at": F.col("date_posted"), "last_seen_at": F.col("date_posted")})
    signals = S.company_signals(jobs)
    return signals.withColumn("quality", S.quality_score(F.col("matching_jobs"), F.col("new_grad_jobs"), F.col("sponsorship"), F.lit("orange"), F.lit(4)))


@query("q_company_tiers", f"WITH {_JOBS} SELECT company, CASE WHEN {_HIT('company', S.P.TIER_1)} THEN 'Tier 1' WHEN {_HIT('company', S.P.TIER_2)} THEN 'Tier 2' ELSE 'Tier 3' END AS tier, count(*) AS n FROM j GROUP BY 1, 2")
def company_tiers(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return jobs.groupBy("company", S.company_tier(F.col("company")).alias("tier")).agg(F.count("*").alias("n"))


@query(
    "q_cache_state",
    "SELECT state, count(*) AS n FROM (SELECT CASE WHEN m.k IS NULL THEN 'missing' WHEN m.k % 3 = 0 THEN 'estimated' WHEN m.k % 7 <> o_orderkey % 5 OR m.score IS NULL THEN 'stale' ELSE 'valid' END AS state FROM orders LEFT JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 > 0 THEN 1 END AS score FROM orders WHERE o_totalprice > 150000) m ON k = o_orderkey) GROUP BY 1",
)
def cache_state(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    cache = orders.where("o_totalprice > 150000").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7).alias("pv"), F.lit(1).alias("prompt"), (F.col("o_orderkey") % 3 == 0).alias("estimated"), F.when(F.col("o_orderkey") % 11 > 0, 1).alias("score"))
    both = orders.join(cache, F.col("k") == F.col("o_orderkey"), "left")
    return both.groupBy(S.cache_state(F.col("pv"), F.col("prompt"), F.col("o_orderkey") % 5, 1, F.col("estimated"), F.col("score")).alias("state")).agg(F.count("*").alias("n"))


@query(
    "q_action_queue",
    f"""WITH {_JOBS}, q AS (SELECT DISTINCT ON (company, title) * FROM j WHERE title IS NOT NULL AND date_posted > {_NOW} - INTERVAL 400 DAY ORDER BY company, title, date_posted DESC, job_id)
    SELECT * FROM (SELECT job_id, company, title, CAST(CASE WHEN {_HIT("company", S.P.QUEUE_OUTREACH_COMPANY)} THEN 35 ELSE 0 END + CASE WHEN {_HIT("title", S.P.QUEUE_EARLY)} OR {_HIT("title", S.P.QUEUE_JUNIOR_LEVEL)} THEN 25 ELSE 0 END + CASE WHEN {_HIT("title", S.P.QUEUE_SENIOR)} THEN 0 ELSE 10 END
      + CASE WHEN {_HIT("company", S.P.QUEUE_DEFENSE_COMPANY)} OR {_HIT("concat_ws(' ', company, title, location)", S.P.QUEUE_DEFENSE)} THEN -100 ELSE 0 END AS INTEGER) AS outreach FROM q) WHERE outreach > 0""",
)
def action_queue(spark, sf_dir):
    """The outreach queue: the freshest item of each group, scored, those above zero."""
    from tessera.operators.relational import first_per_group

    jobs = _jobs(spark, sf_dir).where(F.col("title").isNotNull() & (F.col("date_posted") > as_of() - F.expr("INTERVAL 400 DAY")))
    items = first_per_group(jobs, ["company", "title"], [F.desc("date_posted"), F.asc("job_id")])
    scored = items.withColumn("outreach", S.outreach_score(*[F.col(c) for c in ("company", "title", "location")])[0])
    return scored.where("outreach > 0").select("job_id", "company", "title", "outreach")


@query(
    "q_extraction_worklist",
    "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, quality AS v FROM labels) r ON r.doc_id = d.doc_id WHERE length(d.text) > 400 AND (r.v IS NULL OR r.v < 1) ORDER BY length(d.text) DESC, d.doc_id LIMIT 200",
)
def extraction_worklist(spark, sf_dir):
    """Long enough texts whose extraction is missing or of an older version."""
    from tessera.operators.relational import missing_or_stale

    documents, labels = tab(spark, sf_dir, "documents", "labels")
    done = labels.select("doc_id", "quality").withColumn("wanted_version", F.lit(1))
    long = documents.where(F.length("text") > 400).select("doc_id", F.length("text").alias("n"))
    return missing_or_stale(long, done, "doc_id", F.col("quality")).orderBy(F.desc("n"), "doc_id").limit(200).select("doc_id")


@query(
    "q_board_worklist",
    "SELECT s_suppkey FROM supplier WHERE (s_acctbal < 0 OR s_acctbal BETWEEN 4000 AND 4200) AND s_nationkey < 15 ORDER BY CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END, s_acctbal, s_suppkey LIMIT 40",
)
def board_worklist(spark, sf_dir):
    """Sources never polled, or polled before the cutoff, those first that never were."""
    from tessera.operators.relational import older_than

    (supplier,) = tab(spark, sf_dir, "supplier")
    last = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))
    boards = supplier.where("s_nationkey < 15 AND (s_acctbal < 0 OR s_acctbal >= 4000)").withColumn("last", last)
    return boards.where(older_than(F.col("last"), F.lit(4200.000001))).orderBy(F.asc_nulls_first("last"), "s_acctbal", "s_suppkey").limit(40).select("s_suppkey")
