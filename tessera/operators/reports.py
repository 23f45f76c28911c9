"""Lookups, facets, fact tables and the coverage report over postings, boards and the company registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules as P
from tessera.operators.relational import first_per_group, optional_filters
from tessera.operators.scoring import hits, verify_requirement
from tessera.operators.selection import beside, quantiles


def point_lookup(df: DataFrame, **key) -> DataFrame:
    """The row of a key, or none."""
    return optional_filters(df, **key).limit(1)


def facets(df: DataFrame, as_of: Column, *, bucket: str | None = None, tier: str | None = None, company: str = "", keyword: str = "", salary: bool = False, days: int = 0) -> DataFrame:
    """Postings (title, company, location, salary, bucket, tier, date_posted) that every given facet keeps.

    A posting counts as posted at the end of its day; one without a date is never recent.
    """
    found = optional_filters(df, bucket=bucket, tier=tier)
    wanted, word = company.strip().lower(), keyword.strip().lower()
    if wanted:
        found = found.where(F.contains(F.lower("company"), F.lit(wanted)))
    if word:
        found = found.where(F.contains(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("company", F.lit("")), F.coalesce("location", F.lit("")))), F.lit(word)))
    if salary:
        found = found.where("salary <> ''")
    if days:
        found = found.where(F.date_trunc("day", "date_posted") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND") >= as_of - F.make_dt_interval(days=F.lit(days)))
    return found


def category_counts(df: DataFrame, category: str, reasons: str) -> DataFrame:
    """How many rows each category has, and how many each reason, which counts once a row."""
    names = F.array(F.struct(F.lit("category").alias("kind"), F.col(category).alias("name")))
    why = F.transform(F.array_distinct(F.coalesce(reasons, F.array().cast("array<string>"))), lambda r: F.struct(F.lit("reason").alias("kind"), r.alias("name")))
    return df.select(F.explode(F.concat(names, why)).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def average(value: Column, digits: int = 2) -> Column:
    """Mean of a group, 0 where there is nothing to average."""
    return F.coalesce(F.round(F.avg(value), digits), F.lit(0.0))


def first_with_rows(probes: DataFrame, keys: list[str], order: list[Column], found: str) -> DataFrame:
    """Of each key's probes the first, in their order, that found something."""
    return first_per_group(probes.where(F.col(found) > 0), keys, order).drop("rank_in_group")


def careers_urls(domain: Column) -> Column:
    """Where a company's openings may stand, in the order in which to try."""
    bare = F.btrim(F.lower(F.trim(domain)), F.lit("/"))
    return F.transform(F.array(*map(F.lit, P.CAREERS_TEMPLATES)), lambda t: F.replace(t, F.lit("{domain}"), bare))


def refreshed(requirements: DataFrame) -> DataFrame:
    """Requirements (kind, quoted, posting, state, note) with their state and note worked out anew, and whether either changed."""
    state, note = verify_requirement(F.col("kind"), F.col("quoted"), F.col("posting"))
    both = requirements.withColumns({"new_state": state, "new_note": note})
    changed = ~(F.col("state").eqNullSafe(F.col("new_state")) & F.col("note").eqNullSafe(F.col("new_note")))
    return both.withColumn("changed", changed).drop("state", "note").withColumnsRenamed({"new_state": "state", "new_note": "note"})


def fact_rows(facts: DataFrame) -> DataFrame:
    """Facts (project, weight, pos, tier, claim, technologies) as key and value rows, the first of equal ones.

    Contested facts and blank values give none; a missing tier is OBSERVED.
    """
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), F.trim(value).alias("value"))
    pairs = F.concat(F.array(pair("project_fact", F.col("claim"))), F.coalesce(F.transform("technologies", lambda t: pair("skill", t)), F.array().cast("array<struct<key:string,value:string>>")))
    sure = facts.withColumn("tier", F.coalesce("tier", F.lit("OBSERVED"))).where("tier <> 'CONFLICTED'")
    rows = sure.select("project", "weight", "pos", "tier", F.posexplode(pairs).alias("at", "x")).select("project", "weight", "pos", "tier", "at", "x.key", "x.value").where("value <> ''")
    first = first_per_group(rows.withColumn("same", F.lower("value")), ["project", "key", "same"], [F.asc("pos"), F.asc("at")])
    return first.select("project", "key", "value", "tier", "weight")


def profile_rows(facts: DataFrame) -> DataFrame:
    """Facts (key, value, tier, weight) with the section of a profile that each belongs to.

    Attested facts that only gates look at, and blank values, are left out.  The profile stays a table, so that no
    owner's facts meet in one row.
    """
    key = F.lower(F.trim("key"))
    among = lambda names, prefix: key.isin(names) | key.startswith(prefix)
    section = F.when(among(P.SKILL_KEYS, "skill:"), "skills").when(among(P.ROLE_KEYS, "role:"), "preferred_roles").when(among(P.EDUCATION_KEYS, "education:"), "education").otherwise("highlights")
    gate = F.coalesce((F.col("tier") == "ATTESTED") & key.isin(P.GATE_KEYS), F.lit(False))
    kept = facts.where(~gate & (F.trim("value") != ""))
    return kept.withColumns({"section": section, "value": F.trim("value"), "weight": F.greatest(F.lit(1), F.coalesce("weight", F.lit(1)))})


def early_career(title: Column, bucket: Column) -> Column:
    """Whether the focused page shows a posting: early by its stated experience, or unstated and titled for new graduates."""
    role = F.regexp_replace(title, "<[^>]*>", " ")
    early = (bucket == "early") | ((bucket == "unknown") & hits(role, P.PAGE_NEW_GRAD))
    return F.coalesce(early, F.lit(False)) & ~hits(role, P.PAGE_SENIOR_TITLE) & ~hits(role, P.PAGE_NON_TECH_TITLE)


def _share(part: Column, of: Column) -> Column:
    """Part of ``of`` in percent; callers say what stands for nothing."""
    return F.round(100.0 * part / of, 2)


def _long(df: DataFrame, key: Column, metrics: list[tuple[str, str, Column]]) -> DataFrame:
    """A row for each (section, metric, value) of each row."""
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), v.cast("double").alias("value")) for s, m, v in metrics])
    return df.select(key.alias("key"), F.explode(each).alias("x")).select("x.section", "key", "x.metric", "x.value")


def coverage_report(registry: DataFrame, boards: DataFrame, jobs: DataFrame, runs: DataFrame, as_of: Column, timed: list[str], top: int = 50) -> DataFrame:
    """The twelve sections of the coverage report as rows of (section, key, metric, value).

    ``registry``: ats, status, confidence, board_id; ``boards``: ats, status, tier, next_poll_at; ``jobs``: source, company,
    first_seen, date_posted, expired_at, text; ``runs``: run_id, started_at, finished_at, p50, p95, due, polled.  What is counted by
    source is counted in one pass over the jobs; freshness is told of the sources ``timed``.
    """
    name = lambda *cs: F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("none")) for c in cs])
    whole, n = F.lit(""), F.col("n")
    cells = registry.groupBy("ats", "status", "confidence").agg(F.count("*").alias("n"), F.count("board_id").alias("linked"))
    where = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    totals = cells.agg(
        where(F.lit(True)).alias("total"), where(F.col("status") == "detected").alias("detected"), where((F.col("status") == "detected") & (F.col("confidence") == "high")).alias("verified"), where(F.col("confidence") == "low").alias("low_confidence"),
        where(F.col("status") == "not_found").alias("not_found"), where(F.col("status") == "error").alias("error"), F.coalesce(F.sum("linked"), F.lit(0)).alias("linked"),
    )
    since = lambda x, interval: x >= as_of - F.expr(f"INTERVAL {interval}")
    text, active, seen, gone = F.coalesce("text", F.lit("")), F.col("expired_at").isNull(), F.col("first_seen"), F.col("expired_at")
    minutes = F.when(F.col("source").isin(timed), F.timestamp_diff("SECOND", F.col("date_posted"), seen) / 60)
    counted = jobs.groupBy("source").agg(
        F.count_if(active).alias("active"), F.count_if(active & (text == "")).alias("empty"), F.count_if(active & (F.length(text) < 200)).alias("short"), F.count_if(active & F.contains(text, F.lit("## "))).alias("heading"), F.count_if(active & text.rlike(P.LEFTOVER_MARKUP)).alias("markup"),
        F.count_if(since(seen, "1 HOUR")).alias("h1"), F.count_if(since(seen, "24 HOURS")).alias("h24"), F.count_if(since(seen, "7 DAYS")).alias("d7"), F.count_if(since(gone, "24 HOURS")).alias("gone24"), F.count_if(since(gone, "7 DAYS")).alias("gone7"),
    )
    by_source = beside(counted, ["source"], quantiles(jobs, ["source"], minutes, {"p50": ("continuous", 0.5), "p95": ("continuous", 0.95)}))
    c = F.col
    held, at_least_one = F.nullif(c("active"), F.lit(0)), lambda x: F.greatest(x, F.lit(1))
    sources = _long(by_source, name("source"), [
        ("active_jobs", "jobs", F.nullif(c("active"), F.lit(0))), ("new_jobs", "last_1h", c("h1")), ("new_jobs", "last_24h", c("h24")), ("new_jobs", "last_7d", c("d7")), ("description_quality", "pct_empty", _share(c("empty"), held)), ("description_quality", "pct_lt_200", _share(c("short"), held)),
        ("description_quality", "pct_with_heading", _share(c("heading"), held)), ("description_quality", "pct_leftover_markup", _share(c("markup"), held)), ("freshness", "p50_minutes", c("p50")), ("freshness", "p95_minutes", c("p95")),
    ]).where("value IS NOT NULL")
    expired = by_source.agg(F.coalesce(F.sum("gone24"), F.lit(0)).alias("gone24"), F.coalesce(F.sum("gone7"), F.lit(0)).alias("gone7"))
    polled = boards.where("status <> 'dead'").agg(F.count("*").alias("n"), F.count_if(c("next_poll_at") <= as_of).alias("due"), F.count_if(c("next_poll_at") < as_of - F.expr("INTERVAL 20 MINUTES")).alias("lagged"), F.count_if(since(c("next_poll_at"), "20 MINUTES")).alias("timely"))
    sweep = runs.where("finished_at IS NOT NULL").orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)
    companies = jobs.where(active).groupBy("company", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company", "source").limit(top)
    parts = [
        _long(totals, whole, [("registry", m, c(m)) for m in ("total", "detected", "verified", "low_confidence", "not_found", "error", "linked")]),
        _long(cells.groupBy("ats", "status").agg(F.sum("n").alias("n")), name("ats", "status"), [("registry_by_ats", "companies", n)]),
        _long(cells.where("status = 'unsupported'").groupBy("ats").agg(F.sum("n").alias("n")), name("ats"), [("unsupported_ats", "companies", n)]),
        _long(boards.groupBy("ats", "status", "tier").agg(F.count("*").alias("n")), name("ats", "status", "tier"), [("boards", "boards", n)]),
        sources,
        _long(expired, whole, [("expired_jobs", "last_24h", c("gone24")), ("expired_jobs", "last_7d", c("gone7"))]),
        _long(sweep, whole, [("sweep_health", m, c(m)) for m in ("p50", "p95", "due", "polled")] + [("sweep_health", "pct_polled", _share(c("polled"), at_least_one(c("due"))))]),
        _long(polled, whole, [("schedule", "non_dead", n), ("schedule", "due", c("due")), ("schedule", "lagged_over_20m", c("lagged")), ("schedule", "pct_on_schedule", _share(c("timely"), at_least_one(n)))]),
        _long(companies, name("company", "source"), [("top_companies", "active_jobs", n)]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
