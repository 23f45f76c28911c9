"""Rule cascades and additive scores, each one expression over a row; rules are data, in order of precedence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ontology as O
from tessera.functions import rules as P
from tessera.functions.experience import entry_experience
from tessera.functions.expressions import computed
from tessera.functions.text import US_STATES, display_company, matcher_norm, salary, verbatim_norm
from tessera.operators.relational import best_match, first_per_group


def hits(x: Column, pattern: str) -> Column:
    """Whether the pattern occurs, whatever the case; not in a null text."""
    return F.coalesce(x.rlike(f"(?i){pattern}"), F.lit(False))


def first_match(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds."""
    return reduce(lambda acc, r: F.when(r[0], r[1]).otherwise(acc), reversed(rules), F.lit(otherwise))


def lookup(key: Column, values: dict[str, int], default: int = 0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def added(parts: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """(sum of the points of the parts that hold, their reasons in order)."""
    score = reduce(Column.__add__, (F.when(c, n).otherwise(0) for c, n, _ in parts))
    return score, F.array_compact(F.array(*[F.when(c, r) for c, _, r in parts]))


@dataclass(frozen=True)
class TitleFilter:
    """The patterns of one version of the title filter; those it doesn't have are empty."""

    version: int
    seniority: str = P.SENIORITY_V1
    swe_title: str = P.SWE_TITLE_V2
    clearance: str = ""
    exempt: str = ""
    located: str = ""


TITLE_FILTERS = {
    "v1": TitleFilter(1, swe_title=P.SWE_TITLE_V1),
    "v2": TitleFilter(2),
    "v3": TitleFilter(3, seniority=P.SENIORITY_V3, clearance=P.CLEARANCE_TITLE, exempt=P.EARLY_CAREER_V3, located=P.TITLE_US_LOCATION),
}


def filter_titles(df: DataFrame, version: str, as_of: Column) -> DataFrame:
    """eligible, skip_reason, matched_pattern and filter_version for (title, location, date_posted), in one pass.

    A row that its date or place rules out after the title matched keeps the matched pattern.  Patterns are tried once a row.
    """
    f = TITLE_FILTERS[version]
    t = F.col("title")
    seniority = hits(t, f.seniority) & ~(hits(t, f.exempt) if f.exempt else F.lit(False))
    rules = [(hits(t, P.ROLE_HEAD), "role_head"), (hits(t, P.WRONG_DISCIPLINE), "wrong_discipline"), (seniority, "seniority"), *([(hits(t, f.clearance), "clearance_title")] if f.clearance else []), (~hits(t, f.swe_title), "no_title_match")]
    ruled_out = F.transform(F.array(first_match(rules)), lambda title_reason: F.struct(title_reason.alias("title"), F.coalesce(title_reason, placed(f, as_of)).alias("all")))[0]
    told = df.withColumn("ruled_out", ruled_out)
    reason = F.col("ruled_out.all")
    return told.withColumns({"eligible": reason.isNull(), "skip_reason": reason, "matched_pattern": F.when(F.col("ruled_out.title").isNull(), "swe_title"), "filter_version": F.lit(f.version)}).drop("ruled_out")


def placed(f: TitleFilter, as_of: Column) -> Column:
    """Why the date or the place of a posting whose title fits rules it out."""
    if not f.located:
        return F.lit(None).cast("string")
    old = F.coalesce(F.col("date_posted") < as_of - F.expr("INTERVAL 30 DAYS"), F.lit(False))
    return first_match([(old, "stale_posting"), (F.coalesce(~F.col("location").rlike(f"(?i){f.located}"), F.lit(False)), "non_us_location")])


def in_us(location: Column) -> Column:
    """A place in the United States by name, state suffix or prefix, and none elsewhere."""
    suffix = rf"(?:,|\s)(?:{US_STATES})(?:\s+\d{{5}}(?:-\d{{4}})?)?(?:\s*,?\s*(?:USA|US|United States))?\s*$"
    named = hits(location, P.FEED_US_LOCATION) | F.coalesce(location.rlike(suffix), F.lit(False)) | hits(location, rf"\b(?:US|USA)[\s-]+(?:{US_STATES})\b")
    return named & ~outside_us(location, F.lit(None).cast("string"))


def us_url(url: Column) -> Column:
    """Whether the part of an address that follows ``job`` names a place in the United States."""
    parts = F.split(F.regexp_extract(url, r"^([^?#]*)", 1), "/")
    at = F.array_position(F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(p)), "job")
    place = F.when(at > 0, F.translate(F.get(parts, at.cast("int")), "-_", "  "))
    state = F.coalesce(place.rlike(rf"\s(?:{US_STATES})(?:\s|$)"), F.lit(False))
    return hits(place, r"\b(?:US|USA|United States)\b") | state | hits(place, P.US_STATE_NAMES)


def outside_us(location: Column, url: Column) -> Column:
    """An explicit foreign place in the location or in the address."""
    path = F.regexp_replace(url, "[-_]", " ")
    code = lambda x: F.coalesce(x.rlike(P.FEED_NON_US_CODE), F.lit(False))
    return hits(location, P.FEED_NON_US_LOCATION) | code(location) | hits(path, P.FEED_NON_US_LOCATION) | code(path)


def eligible_title(title: Column, description: Column) -> Column:
    """A technical title without exclusions; staff members of technical staff count whatever else the title says."""
    ruled_out = hits(title, P.FEED_DEFENSE_TITLE) | hits(description, P.FEED_HARD_STOP) | hits(title, P.FEED_HIGH_LEVEL_TITLE)
    return ~ruled_out & (hits(title, r"\b(member of technical staff|mts)\b") | (~hits(title, P.FEED_EXCLUDED_TITLE) & hits(title, P.FEED_TECH_TITLE)))


def entry_title(title: Column, description: Column) -> Column:
    return eligible_title(title, description) & hits(title, P.FEED_ENTRY_TITLE)


def company_tier(company: Column) -> Column:
    return first_match([(hits(company, P.TIER_1), "Tier 1"), (hits(company, P.TIER_2), "Tier 2")], "Tier 3")


def action_score(company: Column, title: Column, location: Column, posted: Column, first_seen: Column, now: Column) -> tuple[Column, Column]:
    """How soon to act on a queue item, and why."""
    hours = F.greatest(F.timestamp_diff("MICROSECOND", first_seen, now) / 3.6e9, F.lit(0.0))
    days = F.greatest(F.floor(F.timestamp_diff("MICROSECOND", posted, now) / 8.64e10), F.lit(0))
    senior = hits(title, P.QUEUE_SENIOR)
    blob = F.concat_ws(" ", company, title, location)
    return added([
        (hits(title, P.QUEUE_EARLY), 55, "early-career"), (hits(title, P.QUEUE_JUNIOR_LEVEL), 35, "sde-i-ii"), (~senior, 18, "not-senior"), (senior, -30, "senior-or-lead"),
        (hours <= 2, 30, "fresh<=2h"), ((hours > 2) & (hours <= 24), 20, "fresh<=24h"), ((hours > 24) & (hours <= 72), 10, "fresh<=72h"),
        (days <= 1, 15, "posted<=1d"), ((days > 1) & (days <= 7), 8, "posted<=7d"), (days > 30, -20, "old-posting"), (hits(location, P.QUEUE_REMOTE_US), 8, "remote-us"),
        (hits(company, P.QUEUE_DEFENSE_COMPANY) | hits(blob, P.QUEUE_DEFENSE), -140, "defense-itar-risk"), (hits(company, P.QUEUE_OUTREACH_COMPANY), 12, "outreach-worthy-company"),
    ])


def outreach_score(company: Column, title: Column, location: Column) -> tuple[Column, Column]:
    """How worthwhile it is to write to the company."""
    return added([
        (hits(company, P.QUEUE_OUTREACH_COMPANY), 35, "known-recruiter-market"), (hits(title, P.QUEUE_EARLY) | hits(title, P.QUEUE_JUNIOR_LEVEL), 25, "candidate-fit-title"), (~hits(title, P.QUEUE_SENIOR), 10, "not-senior"),
        (hits(company, P.QUEUE_DEFENSE_COMPANY) | hits(F.concat_ws(" ", company, title, location), P.QUEUE_DEFENSE), -100, "defense-itar-risk"),
    ])


def company_signals(jobs: DataFrame, key: str = "company") -> DataFrame:
    """Open, new-graduate and matching jobs, sponsorship and last verification of each company.

    Texts are matched one by one, so that nothing is gathered; a phrase that spans two texts isn't found.
    """
    blob = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description_text", F.lit("")))
    matching = hits(blob, P.SOFTWARE) & ~F.coalesce(~F.col("eligible"), F.lit(False))
    status = F.when(F.bool_or(hits(blob, P.SPONSOR_NO)), "no").when(F.bool_or(hits(blob, P.SPONSOR_YES)), "yes").otherwise("unknown")
    return jobs.groupBy(key).agg(F.count("*").alias("open_jobs"), F.count_if(hits(blob, P.NEW_GRAD)).alias("new_grad_jobs"), F.count_if(matching).alias("matching_jobs"), status.alias("sponsorship"), F.max(F.greatest("last_verified_at", "last_seen_at")).alias("last_verified_at"))


def quality_score(matching: Column, new_grad: Column, sponsorship: Column, warning: Column, filings: Column) -> Column:
    """0 to 100 (S12)."""
    raw = F.least(matching * 8, F.lit(40)) + F.least(new_grad * 10, F.lit(20)) + lookup(sponsorship, P.SPONSOR_POINTS) + lookup(warning, P.WARNING_POINTS) + F.least(filings, F.lit(20))
    return F.greatest(F.lit(0), F.least(raw, F.lit(100))).cast("int")


def fallback_score(found: Column) -> Column:
    """Without a model: 15 for each keyword found, at most 100, 5 for none."""
    return F.when(found > 0, F.least(F.lit(100), 15 * found)).otherwise(5)


def cache_state(profile_version: Column, prompt_version: Column, now_profile: Column, now_prompt: int, estimated: Column, score: Column) -> Column:
    """missing, estimated, stale or valid for a cached match."""
    return F.when(profile_version.isNull(), "missing").when(estimated, "estimated").when((profile_version != now_profile) | (prompt_version != now_prompt) | score.isNull(), "stale").otherwise("valid")


def sanitized(score: Column, confidence: Column, strengths: Column, missing: Column) -> list[Column]:
    """A model's answer made safe: score 0 to 100, known confidence, at most 4 strengths and 3 gaps."""
    return [
        F.greatest(F.lit(0), F.least(F.coalesce(score.try_cast("int"), F.lit(0)), F.lit(100))).alias("score"), F.when(F.lower(confidence).isin("low", "medium", "high"), F.lower(confidence)).otherwise("low").alias("confidence"),
        F.slice(F.coalesce(strengths, F.array().cast("array<string>")), 1, 4).alias("strengths"), F.slice(F.coalesce(missing, F.array().cast("array<string>")), 1, 3).alias("missing"),
    ]


def preflight(checks: list[tuple[Column, str]], rejected: Column) -> tuple[Column, Column]:
    """(ready, blocked or rejected; the failed checks) of a packet."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in checks]))
    return F.when(rejected, "rejected").when(F.size(failed) > 0, "blocked").otherwise("ready"), failed


def verify_requirement(kind: Column, quoted: Column, posting: Column) -> tuple[Column, Column]:
    """(VERIFIED, AMBIGUOUS or REJECTED; why) of a requirement with its quotation from the posting."""
    q, text = verbatim_norm(quoted), verbatim_norm(posting)
    at = F.position(q, text)
    context = F.substring(text, F.greatest(at - 500, F.lit(1)), F.length(q) + 200 + F.least(at - 1, F.lit(500)))
    implied = reduce(Column.__or__, ((kind == k) & hits(quoted, p) for k, p in P.IMPLIED_MANDATORY.items()))
    heavy = kind.isin(P.CONSEQUENTIAL)
    soft = F.regexp_extract(quoted, f"(?i){P.SOFTENER}", 0)
    weak = ~hits(quoted, P.MANDATORY) & ~hits(context, P.MANDATORY_CONTEXT) & ~F.coalesce(implied, F.lit(False))
    known = F.coalesce(kind.isin(P.REQUIREMENT_TYPES), F.lit(False))
    note = (
        F.when(F.coalesce(quoted, F.lit("")) == "", "no source_text").when(~known, F.concat(F.lit("unknown hard requirement type: "), F.coalesce(kind, F.lit("None"))))
        .when(~text.contains(q), "source_text not found verbatim in JD").when(heavy & (soft != ""), F.concat(F.lit("hedged: "), soft)).when(heavy & weak, "no mandatory language in snippet").otherwise("")
    )
    return F.when(note == "", "VERIFIED").when(note.startswith("hedged") | note.startswith("no mandatory"), "AMBIGUOUS").otherwise("REJECTED"), note


def role_family(title: Column) -> Column:
    return first_match([(matcher_norm(title).rlike(p), name) for name, p in P.ROLE_FAMILIES], "unknown")


def family_score(family: Column) -> Column:
    return lookup(family, P.FAMILY_SCORES)


def seniority_penalty(title: Column, years: Column) -> Column:
    t = matcher_norm(title)
    return F.when(years >= 3, 0).when(t.rlike(r"\b(staff|principal|architect|manager|director|lead)\b"), 3).when(t.rlike(r"\b(sr|senior)\b"), 2).otherwise(0)


def always_included(key: Column) -> Column:
    k = F.lower(F.trim(key))
    return k.isin(P.ALWAYS_INCLUDED) | reduce(Column.__or__, (k.startswith(p) for p in P.ALWAYS_INCLUDED_PREFIXES))


def select_facts(facts: DataFrame, terms: DataFrame, k: int = 30) -> DataFrame:
    """Of facts (owner, id, key, value, project, weight, tier) those for a list of wanted terms (owner, term).

    A fact scores 3 if one of its terms is wanted, 2 if one implies a wanted one, and its weight, and 1 if observed.
    Those always included come with the first ``k`` of all in order, among which they count.
    """
    from pyspark.sql import Window

    own = facts.select("owner", "id", F.explode(O.requirement_terms(F.concat_ws(" ", "key", "value"))).alias("term"))
    strength = O.relation(own.withColumnRenamed("owner", "f_owner"), terms, ["f_owner", "id"], ["owner"]).where("f_owner = owner").select("owner", "id", "strength")
    scored = facts.join(strength, ["owner", "id"], "left").withColumn("score", F.coalesce("strength", F.lit(0)) + F.greatest(F.lit(1), F.coalesce("weight", F.lit(1))) + F.when(F.col("tier") == "OBSERVED", 1).otherwise(0))
    order = Window.partitionBy("owner").orderBy(F.desc("score"), F.coalesce("project", F.lit("")), "key", "value", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.coalesce(always_included(F.col("key")), F.lit(False)) | (F.col("rank") <= k)).drop("strength")


def feed(jobs: DataFrame, boards: DataFrame, registry: DataFrame, as_of: Column, hours: int, limit: int) -> DataFrame:
    """The published feed, newest first (S19): recent open full-time postings with a link, named by their board or its best
    registry row, past the company, place, title and experience gates, the first of each dedupe key.

    ``jobs``: job_id, board_id, company, title, location, date_posted, first_seen, url, description, dedupe_key, expired_at, employment_type;
    ``boards``: board_id, company_display; ``registry``: board_id, company_name, status, priority.
    """
    recent = jobs.where((F.col("first_seen") > as_of - F.make_dt_interval(hours=F.lit(hours))) & F.col("url").isNotNull() & F.col("expired_at").isNull() & F.coalesce("employment_type", F.lit("unknown")).isin("full_time", "unknown"))
    known = best_match(recent.join(boards, "board_id", "left"), registry, ["board_id"], [(F.col("status") == "detected").desc_nulls_last(), F.asc_nulls_last("priority"), F.asc_nulls_last("company_name")], ["company_name"])
    named = known.withColumn("company", F.coalesce(F.nullif("company_display", F.lit("")), "company_name", "company"))
    place, url, us = F.col("location"), F.col("url"), in_us(F.col("location"))
    gates = ~hits(F.col("company"), P.FEED_DEFENSE_COMPANY) & ~outside_us(place, url) & eligible_title(F.col("title"), F.col("description")) & (us | us_url(url))
    asked = computed(named.where(gates), experience=entry_experience(F.col("description"))).where("experience is not null")
    order = [F.desc("first_seen"), F.desc_nulls_last("date_posted"), F.asc("job_id")]
    keyed = asked.withColumn("key", F.coalesce("dedupe_key", "url"))
    once = first_per_group(keyed, ["key"], order)
    shown = F.when(us, place).when(us_url(url), "United States (from job link)").otherwise("Unknown location")
    newest = once.orderBy(F.desc(F.coalesce("date_posted", "first_seen")), F.desc("first_seen"), F.asc("job_id")).limit(limit)
    # What is only shown is worked out for the rows that are.
    return newest.select("job_id", display_company(F.col("company")).alias("company"), "title", shown.alias("location"), "date_posted", "first_seen", "url", salary(F.col("description")).alias("salary"), "experience", company_tier(F.col("company")).alias("tier"))
