"""Registered queries over postings: texts, requirements and decisions, with their SQL.

The tables hold no postings, so these are dealt from the orders by key: every order is one, with two
phrases as its text, so that each rule meets rows in bulk.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import ontology as O
from tessera.functions import rules as P
from tessera.functions import text as T
from tessera.functions.experience import entry_experience
from tessera.operators import evidence as E
from tessera.operators import scoring as S
from tessera.plans.registry import query
from tessera.plans.relational import as_of, tab

#: In the shapes that the label functions distinguish.
PHRASES = [
    "No experience required. Pay $120,000 - $155,000 a year.", "1+ year of professional experience with Java", "1-2 years of experience, $45/hr", "2 years of backend experience", "Minimum 2 years of experience",
    "2+ years of experience", "At least 2 years of experience", "2 years minimum of experience", "3+ years of experience; interns need 1+ year of experience", "We like people.", "experience of 1 year; $ 90k to $110k",
    "latency went from 200 ms -> 50 ms", "Minimum experience: 2 years", "Pay is $ 95,000 per year", "3 to 5 years of experience", "10 years of experience or more", "zero years of experience",
]
COMPANIES = ["capitalone", "anduril", "openai", "acme corp", "x.myworkdayjobs.com|Big_Site", "spacex", "corner shop"]
TITLES = ["Software Engineer", "Senior Backend Engineer", "Sales Engineer", "New Grad Software Engineer", "Data Engineer", "Staff Platform Engineer", "Member of Technical Staff", "Nurse", "SDE III", "Backend Developer"]
PLACES = ["Seattle, WA", "Remote - US", "London", "Bengaluru, India", "Austin, TX, USA", "Toronto", "New York, NY", "somewhere"]
URL_PLACES = ["Austin-TX", "London", "anywhere", "USA-Remote"]


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _sql(pattern: str, flags: str = "i") -> str:
    return (f"'(?{flags})" if flags else "'") + pattern.replace("'", "''") + "'"


def _pick(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"CAST({key} % {len(values)} + 1 AS INT)"))


_N = len(PHRASES)
_TEXT = f"CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE {_sql_list(PHRASES)}[o_orderkey % {_N} + 1] || ' ' || {_sql_list(PHRASES)}[(o_orderkey // {_N}) % {_N} + 1] END"
_POSTINGS = f"p AS (SELECT o_orderkey AS id, {_TEXT} AS text FROM orders)"


def _text() -> Column:
    return F.when(F.col("o_orderkey") % 101 != 0, F.concat_ws(" ", _pick(PHRASES, "o_orderkey"), _pick(PHRASES, f"(o_orderkey div {_N})")))


def postings(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), _text().alias("text"))


_SALARY = rf"replace(regexp_replace(CASE WHEN coalesce(regexp_extract(text, {_sql(P.SALARY_RANGE, '')}, 1), '') <> '' THEN regexp_extract(text, {_sql(P.SALARY_RANGE, '')}, 1) ELSE coalesce(regexp_extract(text, {_sql(P.SALARY_RATE)}, 1), '') END, '\s+', ' ', 'g'), '$ ', '$')"


@query("q_salary_extract", f"WITH {_POSTINGS} SELECT id, {_SALARY} AS salary FROM p")
def salary_extract(spark, sf_dir):
    return postings(spark, sf_dir).select("id", T.salary(F.col("text")).alias("salary"))


def _stated(pattern: str) -> str:
    """SQL: the statements of a pattern, each with low, high and whether it is open-ended."""
    p = _sql(pattern, "is")
    parts = f"regexp_extract_all(text, {p}, 0) AS w, regexp_extract_all(text, {p}, 1) AS l, regexp_extract_all(text, {p}, 2) AS h, regexp_split_to_array(text, {p}) AS b"
    one = rf"{{'low': CAST(l[i + 1] AS INTEGER), 'high': CAST(coalesce(nullif(h[i + 1], ''), l[i + 1]) AS INTEGER), 'open': (coalesce(h[i + 1], '') = '' AND regexp_matches(w[i + 1], '\b' || l[i + 1] || '\s*\+')) OR regexp_matches(b[i + 1], {_sql(P.OPEN_BEFORE)}) OR regexp_matches(b[i + 2], {_sql(P.OPEN_AFTER)})}}"
    return f"SELECT id, list_transform(range(len(w)), lambda i: {one}) AS a FROM (SELECT id, {parts} FROM p)"


_LABEL = "CASE WHEN low = 1 AND high = 1 THEN '1 year' WHEN low = high THEN low || ' years' ELSE low || '–' || high || ' years' END"
_EXPERIENCE = f"""s1 AS ({_stated(P.YEARS_BEFORE_EXPERIENCE)}), s2 AS ({_stated(P.EXPERIENCE_BEFORE_YEARS)}), e0 AS (SELECT p.id, p.text, list_concat(s1.a, s2.a) AS a FROM p JOIN s1 USING (id) JOIN s2 USING (id)),
    e1 AS (SELECT *, list_min(list_transform(a, lambda x: x.low)) AS low, list_max(list_transform(a, lambda x: x.high)) AS high FROM e0),
    e AS (SELECT id, CASE WHEN coalesce(text, '') = '' OR regexp_matches(text, {_sql(P.OPEN_ENDED_TWO_PLUS)}) THEN NULL WHEN regexp_matches(text, {_sql(P.NO_EXPERIENCE)}) THEN '0 years' WHEN len(a) > 0 AND len(list_filter(a, lambda x: x.high > 2 OR x.low > 2 OR (x.low >= 2 AND x.open))) = 0 THEN {_LABEL} END AS experience FROM e1)"""
_Y = _sql(P.YEARS_STATED, "is")
_LABELS = f"""l0 AS (SELECT id, text, regexp_extract(text, {_Y}, 0) AS w, CAST(coalesce(nullif(regexp_extract(text, {_Y}, 1), ''), nullif(regexp_extract(text, {_Y}, 3), '')) AS INTEGER) AS low, CAST(coalesce(nullif(regexp_extract(text, {_Y}, 2), ''), nullif(regexp_extract(text, {_Y}, 4), '')) AS INTEGER) AS high0 FROM p),
    l AS (SELECT id, CASE WHEN coalesce(text, '') = '' THEN 'Not stated' WHEN regexp_matches(text, {_sql(P.NO_EXPERIENCE)}) THEN '0 years' WHEN w = '' THEN 'Not stated' WHEN contains(w, '+') THEN low || '+ years' ELSE {_LABEL} END AS label FROM (SELECT *, coalesce(high0, low) AS high FROM l0))"""


@query("q_experience_extract", f"WITH {_POSTINGS}, {_EXPERIENCE}, {_LABELS} SELECT id, experience, label FROM e JOIN l USING (id)")
def experience_extract(spark, sf_dir):
    return postings(spark, sf_dir).select("id", entry_experience(F.col("text")).alias("experience"), T.experience_label(F.col("text")).alias("label"))


@query(
    "q_experience_buckets",
    f"""WITH {_POSTINGS}, {_LABELS}, n AS (SELECT id, label, list_transform(regexp_extract_all(label, '\\d+'), lambda x: CAST(x AS INTEGER)) AS n FROM l)
    SELECT id, CASE WHEN len(n) = 0 THEN 'unknown' WHEN contains(label, '+') THEN CASE WHEN n[1] < 2 THEN 'one-plus' WHEN n[1] = 2 THEN 'two-plus' WHEN n[1] < 6 THEN 'three-plus' ELSE 'senior' END WHEN coalesce(n[2], n[1]) <= 2 THEN 'early' WHEN n[1] <= 5 THEN 'mid' ELSE 'senior' END AS bucket FROM n""",
)
def experience_buckets(spark, sf_dir):
    return postings(spark, sf_dir).select("id", T.experience_bucket(T.experience_label(F.col("text"))).alias("bucket"))


_HIT = lambda x, p: f"coalesce(regexp_matches({x}, {_sql(p)}), false)"
_SUFFIX = rf"(?:,|\s)(?:{T.US_STATES})(?:\s+\d{{5}}(?:-\d{{4}})?)?(?:\s*,?\s*(?:USA|US|United States))?\s*$"
_OUT = lambda x: f"({_HIT(x, P.FEED_NON_US_LOCATION)} OR coalesce(regexp_matches({x}, {_sql(P.FEED_NON_US_CODE, '')}), false))"
_IN = rf"(({_HIT('location', P.FEED_US_LOCATION)} OR coalesce(regexp_matches(location, {_sql(_SUFFIX, '')}), false) OR {_HIT('location', rf'\b(?:US|USA)[\s-]+(?:{T.US_STATES})\b')}) AND NOT {_OUT('location')})"
_PATH = "translate(regexp_extract(url, '/job/([^/?#]*)/', 1), '-_', '  ')"
_URL_US = rf"({_HIT(_PATH, r'\b(?:US|USA|United States)\b')} OR coalesce(regexp_matches({_PATH}, {_sql(rf'\s(?:{T.US_STATES})(?:\s|$)', '')}), false) OR {_HIT(_PATH, P.US_STATE_NAMES)})"
_SHOWN = {"capitalone": "Capital One", "openai": "Openai", "acme corp": "Acme Corp", "x.myworkdayjobs.com|Big_Site": "Big Site", "corner shop": "Corner Shop"}


@query(
    "q_feed",
    f"""WITH {_POSTINGS}, {_EXPERIENCE}, j AS (SELECT o_orderkey AS job_id, CAST(o_custkey % 100 + 1 AS BIGINT) AS board_id, {_sql_list(COMPANIES)}[o_custkey % {len(COMPANIES)} + 1] AS own, {_sql_list(TITLES)}[o_orderkey % {len(TITLES)} + 1] AS title, CASE WHEN o_orderkey % 9 > 0 THEN {_sql_list(PLACES)}[o_orderkey % {len(PLACES)} + 1] END AS location,
      CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate - INTERVAL 2 DAY END AS date_posted, o_orderdate AS first_seen, CASE WHEN o_orderkey % 13 > 0 THEN 'https://x.com/job/' || {_sql_list(URL_PLACES)}[o_custkey % {len(URL_PLACES)} + 1] || '/' || (o_orderkey % 400) || '?utm_source=a' END AS url, p.text, o_orderkey % 17 = 0 AS expired, o_orderkey % 19 = 0 AS contract FROM orders JOIN p ON p.id = o_orderkey),
    r AS (SELECT DISTINCT ON (board_id) board_id, company_name FROM (SELECT CAST(p_size AS BIGINT) AS board_id, p_brand AS company_name, p_partkey % 2 = 0 AS detected, p_partkey % 5 AS priority FROM part) ORDER BY board_id, detected DESC, priority, company_name),
    k AS (SELECT j.*, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_name END, company_name, own) AS company, e.experience FROM j JOIN e ON e.id = job_id LEFT JOIN supplier ON s_suppkey = board_id LEFT JOIN r USING (board_id)),
    g AS (SELECT *, {_IN} AS us, row_number() OVER (PARTITION BY coalesce(title || '|' || location, url) ORDER BY first_seen DESC, date_posted DESC NULLS LAST, job_id) AS nth FROM k
      WHERE first_seen > TIMESTAMP '2001-08-01' - INTERVAL 48000 HOUR AND url IS NOT NULL AND NOT expired AND NOT contract AND NOT {_HIT('company', P.FEED_DEFENSE_COMPANY)} AND NOT {_OUT('location')} AND NOT {_OUT("translate(url, '-_', '  ')")}
      AND NOT {_HIT('title', P.FEED_DEFENSE_TITLE)} AND NOT {_HIT('text', P.FEED_HARD_STOP)} AND NOT {_HIT('title', P.FEED_HIGH_LEVEL_TITLE)} AND ({_HIT('title', r'\b(member of technical staff|mts)\b')} OR (NOT {_HIT('title', P.FEED_EXCLUDED_TITLE)} AND {_HIT('title', P.FEED_TECH_TITLE)}))
      AND ({_IN} OR {_URL_US}) AND experience IS NOT NULL)
    SELECT job_id, CASE company {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _SHOWN.items())} ELSE upper(left(split_part(company, '#', 1), 1)) || lower(substr(split_part(company, '#', 1), 2)) || CASE WHEN contains(company, '#') THEN '#' || split_part(company, '#', 2) ELSE '' END END AS company, title, CASE WHEN us THEN location ELSE 'United States (from job link)' END AS location, {_SALARY} AS salary, experience,
      CASE WHEN {_HIT('company', P.TIER_1)} THEN 'Tier 1' WHEN {_HIT('company', P.TIER_2)} THEN 'Tier 2' ELSE 'Tier 3' END AS tier FROM g WHERE nth = 1 ORDER BY coalesce(date_posted, first_seen) DESC, first_seen DESC, job_id LIMIT 60""",
)
def feed(spark, sf_dir):
    """The published feed as one plan."""
    orders, part, supplier = tab(spark, sf_dir, "orders", "part", "supplier")
    k = F.col("o_orderkey")
    url = F.when(k % 13 > 0, F.concat(F.lit("https://x.com/job/"), _pick(URL_PLACES, "o_custkey"), F.lit("/"), (k % 400).cast("string"), F.lit("?utm_source=a")))
    jobs = orders.select(
        k.alias("job_id"), (F.col("o_custkey") % 100 + 1).alias("board_id"), _pick(COMPANIES, "o_custkey").alias("company"), _pick(TITLES, "o_orderkey").alias("title"), F.when(k % 9 > 0, _pick(PLACES, "o_orderkey")).alias("location"),
        F.when(k % 5 > 0, F.col("o_orderdate") - F.expr("INTERVAL 2 DAYS")).alias("date_posted"), F.col("o_orderdate").alias("first_seen"), url.alias("url"), _text().alias("description"),
        F.when(k % 17 == 0, F.col("o_orderdate")).alias("expired_at"), F.when(k % 19 == 0, "contract").when(k % 2 == 0, "full_time").alias("employment_type"),
    ).withColumn("dedupe_key", F.concat("title", F.lit("|"), "location"))
    boards = supplier.select(F.col("s_suppkey").alias("board_id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise("").alias("company_display"))
    registry = part.select(F.col("p_size").cast("long").alias("board_id"), F.col("p_brand").alias("company_name"), F.when(F.col("p_partkey") % 2 == 0, "detected").otherwise("open").alias("status"), (F.col("p_partkey") % 5).alias("priority"))
    return S.feed(jobs, boards, registry, as_of(), 48000, 60).select("job_id", "company", "title", "location", "salary", "experience", "tier")


QUOTED = [
    "We build tools. Requirements: 3+ years of experience. You must be a U.S. person. Python preferred; a BS degree. Remote.", "Rust or  Go. Based in Austin. Secret clearance a plus.", "",
]
QUOTES = [
    ("years", "3+ years of experience"), ("citizenship", "must be a U.S. person"), ("education", "a BS degree"), ("education", "Python preferred; a BS"), ("skill", "Python"), ("skill", "Rust or Go"), ("salary", "tools"), ("clearance", "We build"), (None, "Remote"), ("location", ""),
    ("location", "Based in Austin"), ("clearance", "Secret clearance a plus"), ("authorization", "Rust"),
]
_KINDS = "[" + ", ".join("NULL" if k is None else f"'{k}'" for k, _ in QUOTES) + "]"
_NORMED = lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


@query(
    "q_requirement_verify",
    f"""WITH q AS (SELECT o_orderkey AS id, {_KINDS}[o_orderkey % {len(QUOTES)} + 1] AS kind, {_sql_list([q for _, q in QUOTES])}[o_orderkey % {len(QUOTES)} + 1] AS quoted, {_sql_list(QUOTED)}[(o_orderkey // 7) % {len(QUOTED)} + 1] AS posting FROM orders),
    t AS (SELECT *, {_NORMED('quoted')} AS q, {_NORMED('posting')} AS t FROM q), c AS (SELECT *, substr(t, greatest(strpos(t, q) - 500, 1), length(q) + 200 + least(strpos(t, q) - 1, 500)) AS around, coalesce(list_contains({_sql_list(P.CONSEQUENTIAL)}, kind), false) AS heavy, regexp_extract(quoted, {_sql(P.SOFTENER)}, 0) AS soft,
      {' OR '.join(f"(coalesce(kind, '') = '{k}' AND {_HIT('quoted', p)})" for k, p in P.IMPLIED_MANDATORY.items())} AS implied FROM t),
    n AS (SELECT id, CASE WHEN quoted = '' THEN 'no source_text' WHEN NOT coalesce(list_contains({_sql_list(P.REQUIREMENT_TYPES)}, kind), false) THEN 'unknown hard requirement type: ' || coalesce(kind, 'None') WHEN NOT contains(t, q) THEN 'source_text not found verbatim in JD'
      WHEN heavy AND soft <> '' THEN 'hedged: ' || soft WHEN heavy AND NOT {_HIT('quoted', P.MANDATORY)} AND NOT {_HIT('around', P.MANDATORY_CONTEXT)} AND NOT implied THEN 'no mandatory language in snippet' ELSE '' END AS note FROM c)
    SELECT id, CASE WHEN note = '' THEN 'VERIFIED' WHEN note LIKE 'hedged%' OR note LIKE 'no mandatory%' THEN 'AMBIGUOUS' ELSE 'REJECTED' END AS state, note FROM n""",
)
def requirement_verify(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    at = lambda xs, key: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), F.expr(f"CAST({key} % {len(xs)} + 1 AS INT)"))
    rows = orders.select(F.col("o_orderkey").alias("id"), at([k for k, _ in QUOTES], "o_orderkey").alias("kind"), at([q for _, q in QUOTES], "o_orderkey").alias("quoted"), at(QUOTED, "(o_orderkey div 7)").alias("posting"))
    state, note = S.verify_requirement(F.col("kind"), F.col("quoted"), F.col("posting"))
    return rows.select("id", state.alias("state"), note.alias("note"))


CANDIDATE = E.Candidate(skills={"Python": 9, "FastAPI": 6, "PostgreSQL": 5, "Docker": 4}, text="Python FastAPI PostgreSQL Docker backend services, B.S. computer science", years=1.66, attested={"citizenship": "US", "us_person": True, "security_clearance": "none", "current_location": "Seattle"})
REQUIREMENTS = "array<struct<type:string,value:string,skill:string,min_years:double,source_text:string,verification_state:string>>"
#: Requirements that a posting has if its key can be divided, and what the candidate's facts make of each: verdict, weight.
ASKED = [
    (2, True, "skill", "Python", "VERIFIED", "matched", 9), (3, True, "skill", "FastAPI", "VERIFIED", "matched", 6), (4, True, "skill", "docker", "VERIFIED", "matched", 4), (5, True, "skill", "Rust", "VERIFIED", "unmet", 0), (7, True, "clearance", "active secret clearance", "VERIFIED", "blocked", 0),
    (11, True, "citizenship", "U.S. citizen", "AMBIGUOUS", "open", 0), (1, True, "education", "Bachelor degree", "VERIFIED", "met", 0), (17, True, "skill", "Go", "REJECTED", "skipped", 0), (13, False, None, "PostgreSQL", "VERIFIED", "matched", 5), (19, False, None, "Rust", "VERIFIED", "missing", 0),
]
JOB_TITLES = [("Backend Engineer", 3, 0), ("Senior Backend Engineer", 3, 2), ("QA Engineer", -3, 0), ("Software Engineer", 1, 0), ("Gardener", 0, 0), ("Staff Platform Engineer", 3, 3)]
JOB_COMPANIES = ["acme", "acme", "acme", "acme", "acme", "Anduril Industries"]
YEARS = [None, 1.0, 2.0, 3.0, 6.0]


def decided(spark, sf_dir):
    (orders,) = tab(spark, sf_dir, "orders")
    asked = lambda hard: F.array_compact(F.array(*[F.when(F.col("o_orderkey") % n == 0, F.struct(F.lit(kind).cast("string").alias("type"), F.lit(value).alias("value"), F.lit(None).cast("string").alias("skill"), F.lit(None).cast("double").alias("min_years"), F.lit(value).alias("source_text"), F.lit(state).alias("verification_state"))) for n, is_hard, kind, value, state, _, _ in ASKED if is_hard == hard])).cast(REQUIREMENTS)
    years = F.element_at(F.array(*[F.lit(y).cast("double") for y in YEARS]), F.expr(f"CAST((o_orderkey div 3) % {len(YEARS)} + 1 AS INT)"))
    rows = orders.select(F.col("o_orderkey").alias("job_id"), _pick([t for t, _, _ in JOB_TITLES], "(o_orderkey div 2)").alias("title"), _pick(JOB_COMPANIES, "(o_orderkey div 5)").alias("company"), years.alias("years_min"), asked(True).alias("hard"), asked(False).alias("preferred"))
    return E.decide(rows, CANDIDATE)


_DECIDED = f"""a AS (SELECT * FROM (VALUES {', '.join(f"({n}, '{verdict}', {weight})" for n, _, _, _, _, verdict, weight in ASKED)}) v(every, verdict, weight)),
    t AS (SELECT o_orderkey AS job_id, {[f for _, f, _ in JOB_TITLES]}[(o_orderkey // 2) % {len(JOB_TITLES)} + 1] AS family, {[x for _, _, x in JOB_TITLES]}[(o_orderkey // 2) % {len(JOB_TITLES)} + 1] AS penalty, (o_orderkey // 5) % {len(JOB_COMPANIES)} = 5 AS policy, [NULL, 1.0, 2.0, 3.0, 6.0][(o_orderkey // 3) % 5 + 1] AS years FROM orders),
    v AS (SELECT job_id, any_value(family) AS family, any_value(penalty) AS penalty, any_value(policy) AS policy, any_value(years) AS years, count(*) FILTER (WHERE verdict = 'blocked') AS blocked, count(*) FILTER (WHERE verdict IN ('unmet', 'open')) AS unclear, count(*) FILTER (WHERE verdict = 'matched') AS matched, CAST(coalesce(sum(weight) FILTER (WHERE verdict = 'matched'), 0) AS INTEGER) AS weight, count(*) FILTER (WHERE verdict IN ('unmet', 'missing')) AS gaps FROM t JOIN a ON job_id % every = 0 GROUP BY job_id),
    d AS (SELECT *, CASE WHEN blocked > 0 THEN 'SKIP_HARD' WHEN unclear > 0 OR policy THEN 'REVIEW' WHEN years >= 5 THEN 'SKIP' WHEN weight = 0 THEN 'REVIEW' WHEN years >= 3 THEN 'STRETCH' WHEN family > 0 AND penalty = 0 AND (matched >= 4 OR weight >= 20) THEN 'APPLY' ELSE 'REVIEW' END AS action FROM v)"""


@query("q_evidence_decision", f"WITH {_DECIDED} SELECT job_id, action, weight AS matched_weight, CAST(gaps AS INTEGER) AS missing_weight, family AS family_score, penalty AS seniority_penalty FROM d")
def evidence_decision(spark, sf_dir):
    return decided(spark, sf_dir).select("job_id", "action", "matched_weight", "missing_weight", "family_score", "seniority_penalty")


@query(
    "q_packet_candidates",
    f"WITH {_DECIDED} SELECT job_id, action, CAST(row_number() OVER (ORDER BY action, family DESC, penalty, weight DESC, gaps, unclear + CASE WHEN policy THEN 1 ELSE 0 END, job_id) AS INTEGER) AS rank FROM d WHERE action IN ('APPLY', 'STRETCH') AND job_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ORDER BY rank LIMIT 1000",
)
def packet_candidates(spark, sf_dir):
    """Decisions worth a packet, best first, without those that have one."""
    (orders,) = tab(spark, sf_dir, "orders")
    built = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    best = decided(spark, sf_dir).where(F.col("action").isin("APPLY", "STRETCH")).join(built, "job_id", "left_anti")
    return E.with_rank(best).select("job_id", "action", "rank")


TERMS = ["FastAPI", "k8s", "cpp", "Postgres  SQL", "CI/CD", "TS", "docker", "Unknown Thing", "rest", ""]
_ALIASES = "al AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in O.ALIAS_OF.items()) + ") v(alias, term))"
_BROADER = "br AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{w}')" for t, wide in O.BROADER.items() for w in wide) + ") v(term, broader))"


@query(
    "q_ontology_expand",
    f"""WITH {_ALIASES}, {_BROADER}, r AS (SELECT p_partkey, trim(regexp_replace(replace(lower({_sql_list(TERMS)}[p_partkey % {len(TERMS)} + 1]), '/', ' '), '\\s+', ' ', 'g')) AS raw FROM part),
    c AS (SELECT p_partkey, coalesce(al.term, raw) AS term FROM r LEFT JOIN al ON alias = raw WHERE raw <> '') SELECT p_partkey, term FROM c UNION SELECT p_partkey, broader FROM c JOIN br USING (term)""",
)
def ontology_expand(spark, sf_dir):
    (part,) = tab(spark, sf_dir, "part")
    return O.expanded(part.select("p_partkey", _pick(TERMS, "p_partkey").alias("raw")), "raw", "p_partkey")


SKILLS, WANTED = ["python", "fastapi", "docker", "kubernetes", "rust", "postgresql", "react"], ["python", "containers", "database"]


@query(
    "q_fact_selection",
    f"""WITH {_BROADER}, f AS (SELECT p_brand AS owner, p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 'degree' ELSE 'skill' END AS key, {_sql_list(SKILLS)}[p_partkey % {len(SKILLS)} + 1] AS value, p_type AS project, p_size % 13 AS weight, p_partkey % 3 = 0 AS seen FROM part),
    s AS (SELECT *, CASE WHEN list_contains({_sql_list(WANTED)}, value) THEN 3 WHEN value IN (SELECT term FROM br WHERE list_contains({_sql_list(WANTED)}, broader)) THEN 2 ELSE 0 END + greatest(1, weight) + CASE WHEN seen THEN 1 ELSE 0 END AS score FROM f)
    SELECT owner, id, CAST(score AS INTEGER) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, project, key, value, id) AS rank FROM s) WHERE key = 'degree' OR rank <= 15""",
)
def fact_selection(spark, sf_dir):
    (part,) = tab(spark, sf_dir, "part")
    facts = part.select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 9 == 0, "degree").otherwise("skill").alias("key"), _pick(SKILLS, "p_partkey").alias("value"), F.col("p_type").alias("project"), (F.col("p_size") % 13).alias("weight"), F.when(F.col("p_partkey") % 3 == 0, "OBSERVED").otherwise("ATTESTED").alias("tier"))
    terms = part.select(F.col("p_brand").alias("owner")).distinct().select("owner", F.explode(F.array(*map(F.lit, WANTED))).alias("term"))
    return S.select_facts(facts, terms, 15).select("owner", "id", F.col("score").cast("int").alias("score"), "rank")


FACTS = ["Led 5 people", "10% faster", "at scale"]
_CLAIMS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, {_sql(p)}, 0)) AS span FROM documents" for k, p in P.RISKS.items())


@query("q_claim_sweep", f"SELECT doc_id, kind, count(*) AS claims, min(lower(span)) AS least FROM ({_CLAIMS}) WHERE len(list_filter({_sql_list([f.lower() for f in FACTS])}, lambda f: contains(f, lower(span)))) = 0 GROUP BY 1, 2")
def claim_sweep(spark, sf_dir):
    """Risky phrases of whole texts that no allowed fact supports, by kind."""
    (documents,) = tab(spark, sf_dir, "documents")
    claims = documents.select("doc_id", F.explode(T.unsupported_claims(F.col("text"), F.array(*map(F.lit, FACTS)))).alias("c"))
    return claims.groupBy("doc_id", "c.kind").agg(F.count("*").alias("claims"), F.min(F.lower("c.span")).alias("least"))
