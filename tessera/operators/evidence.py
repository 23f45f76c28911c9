"""Whether a candidate's facts meet a posting's requirements: one verdict for each requirement, one decision for each posting."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ontology as O
from tessera.functions.text import matcher_norm
from tessera.operators.scoring import family_score, role_family, seniority_penalty

# Kinds that need attested facts, thresholds in years, and what is enough to apply.
ATTESTED_KINDS = ["citizenship", "clearance", "authorization", "residency"]
YEARS_GAP, YEARS_OUT, YEARS_TOLERANCE, ENOUGH_MATCHES, ENOUGH_WEIGHT = 3, 5, 0.5, 4, 20
US_NAMES = ["us", "usa", "united states"]
US_PERSON = ["u.s. person", "u.s person", "us person", "export controlled", "export-controlled"]
US_CITIZEN = ["u.s", "us citizen", "united states"]
NO_SPONSOR = ["does not offer", "unable to sponsor", "will not sponsor"]
DEGREES = ["b.s", "bs", "b tech", "b.tech", "bachelor", "m.s", "ms", "master"]
REVIEWED_COMPANIES = {"andurilindustries": "company_defense_or_export_control_risk"}
ACTION_ORDER = ["SKIP_HARD", "SKIP", "REVIEW", "STRETCH", "APPLY"]


@dataclass
class Candidate:
    """One candidate: weighted skills, free text, years of experience, and attested facts."""

    skills: dict[str, int] = field(default_factory=dict)
    text: str = ""
    years: float = 0.0
    attested: dict = field(default_factory=dict)

    def fact(self, *names: str) -> str:
        """The first attested fact of these, normalized."""
        value = next((self.attested[n] for n in names if self.attested.get(n)), "")
        return re.sub(r"[^a-z0-9+#.]+", " ", str(value).lower()).strip()

    def weights(self) -> dict[str, int]:
        """The largest weight of each canonical term that the skills are or imply."""
        out: dict[str, int] = {}
        for skill, weight in self.skills.items():
            plain = " ".join(skill.lower().replace("/", " ").split())
            base = O.ALIAS_OF.get(plain, plain)
            for t in (base, *O.BROADER.get(base, ())):
                out[t] = max(out.get(t, 0), weight)
        return out


def _any_in(x: Column, phrases: list[str]) -> Column:
    return reduce(Column.__or__, (x.contains(p) for p in phrases))


def _label(r: Column) -> Column:
    given = [F.nullif(r[c], F.lit("")) for c in ("value", "skill", "source_text")]
    return F.coalesce(*given, F.lit(""))


def _met(c: Candidate, kind: Column, label: Column, source: Column, min_years: Column, terms: Column) -> Column:
    """Whether the candidate's facts meet a requirement."""
    true, false, text = F.lit(True), F.lit(False), F.lit(matcher_text(c.text))
    citizenship, place = c.fact("citizenship"), c.fact("current_location", "location")
    weights = c.weights()
    known = F.arrays_overlap(terms, F.array(*map(F.lit, weights)).cast("array<string>")) if weights else false
    citizen = F.when(_any_in(label, US_PERSON), F.lit(c.attested.get("us_person") is True)).when(_any_in(label, US_CITIZEN), F.lit(citizenship in US_NAMES)).otherwise((label.contains(citizenship)) if citizenship else false)
    both = F.concat_ws(" ", label, source)
    located = _any_in(both, ["remote", "united states", "usa"]) | (both.contains(place) if place else false) | F.lit(c.attested.get("willing_to_relocate") is True)
    degree = ~_any_in(both, ["bachelor", "b.s", "bs"]) | F.lit(any(d in matcher_text(c.text) for d in DEGREES))
    return (
        F.when(kind == "citizenship", citizen & ~_contradicted(c, kind, label)).when(kind == "skill", known | ((source != "") & text.contains(source))).when(kind == "education", degree)
        .when(kind == "years", min_years.isNull() | (F.lit(c.years) >= min_years)).when(kind == "location", located)
        .when(kind == "clearance", F.lit(bool(c.attested.get("clearance")))).when(kind == "authorization", F.lit(bool(c.attested.get("authorization")))).when(kind == "residency", F.lit(bool(c.attested.get("residency"))))
        .otherwise(text.contains(label))
    ) & true


def matcher_text(x: str) -> str:
    return re.sub(r"[^a-z0-9+#.]+", " ", x.lower()).strip()


def _contradicted(c: Candidate, kind: Column, label: Column) -> Column:
    """Whether an attested fact rules the requirement out."""
    false = F.lit(False)
    citizenship, place = c.fact("citizenship"), c.fact("current_location", "location")
    not_person = _any_in(label, US_PERSON) if c.attested.get("us_person") is False else false
    foreign = _any_in(label, US_CITIZEN) if citizenship and citizenship not in US_NAMES else false
    sponsor = _any_in(label, NO_SPONSOR) if c.attested.get("requires_sponsorship") is True else false
    elsewhere = ~label.contains(place) if place and c.attested.get("willing_to_relocate") is not True else false
    return F.when(kind == "citizenship", not_person | foreign).when(kind == "clearance", F.lit(c.fact("security_clearance") == "none")).when(kind == "authorization", sponsor).when(kind == "residency", elsewhere).otherwise(false)


def verdicts(postings: DataFrame, c: Candidate) -> DataFrame:
    """job_id, pos, label, verdict, weight and reason of each requirement of (job_id, hard, preferred).

    ``hard`` and ``preferred`` are arrays of structs (type, value, skill, min_years, source_text, verification_state).
    Verdicts: matched, met, missing (a wish), unmet, blocked, open, skipped.
    """
    rows = postings.select("job_id", F.posexplode(F.concat(F.transform("hard", lambda r: F.struct(F.lit(True).alias("hard"), r.alias("r"))), F.transform("preferred", lambda r: F.struct(F.lit(False).alias("hard"), r.alias("r"))))).alias("pos", "x"))
    r, kind = F.col("x.r"), F.col("x.r.type")
    asked = F.when(F.col("x.hard"), F.coalesce(F.nullif(r["skill"], F.lit("")), r["value"])).otherwise(_label(r))
    rows = rows.select("job_id", "pos", F.col("x.hard").alias("hard"), kind.alias("kind"), _label(r).alias("label"), matcher_norm(_label(r)).alias("norm"), matcher_norm(r["source_text"]).alias("source"), r["min_years"].alias("min_years"), r["verification_state"].alias("state"), O.requirement_terms(asked).alias("terms"), O.requirement_terms(_label(r)).alias("label_terms"))
    kind, hard = F.col("kind"), F.col("hard")
    weights = c.weights()
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,int>")
    weight = F.greatest(F.coalesce(F.array_max(F.transform("label_terms", lambda t: F.try_element_at(table, t))), F.lit(1)), F.lit(1))
    met = _met(c, kind, F.col("norm"), F.col("source"), F.col("min_years"), F.col("terms"))
    wish = F.arrays_overlap("label_terms", F.array(*map(F.lit, weights)).cast("array<string>")) if weights else F.lit(False)
    wish = wish | ((F.col("norm") != "") & F.lit(matcher_text(c.text)).contains(F.col("norm")))
    verified = F.coalesce(F.col("state") == "VERIFIED", F.lit(False))
    ambiguous = F.coalesce((F.col("state") == "AMBIGUOUS") & kind.isin(ATTESTED_KINDS), F.lit(False))
    blocks = F.when(kind.isin(*ATTESTED_KINDS, "location", "education"), _contradicted(c, kind, F.col("norm"))).when(kind.isin("skill", "years"), F.lit(False)).otherwise(F.lit(True))
    verdict = (
        F.when(~hard & wish, "matched").when(~hard, "missing").when(ambiguous, "open").when(~verified | (kind == "years"), "skipped")
        .when(met & (kind == "skill"), "matched").when(met, "met").when(blocks, "blocked").otherwise("unmet")
    )
    placed = bool(c.attested.get("location") or c.attested.get("current_location") or c.attested.get("willing_to_relocate") is True)
    reason = F.when(F.col("verdict") == "open", "ambiguous_requirement").when(F.col("verdict") == "unmet", F.when(kind.isin(ATTESTED_KINDS) | ((kind == "location") & F.lit(not placed)), "missing_attested_profile_fact").when(kind == "skill", "missing_profile_fact_or_exact_match").otherwise("unresolved_requirement"))
    return rows.withColumn("verdict", verdict).withColumn("weight", weight).withColumn("reason", reason).select("job_id", "pos", "kind", "label", "verdict", "weight", "reason")


def decide(postings: DataFrame, c: Candidate) -> DataFrame:
    """The decision for each posting (job_id, title, company, years_min, hard, preferred).

    Blocked requirements come first, then open ones, then years far short, no match at all, years short, and last
    whether the role's family, level and matches are enough to apply.
    """
    each = verdicts(postings, c)
    skill_gap = (F.col("verdict").isin("unmet", "blocked") & (F.col("kind") == "skill")) | (F.col("verdict") == "missing")
    of = lambda cond: F.coalesce(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "label")))), F.array())
    per = each.groupBy("job_id").agg(
        of(F.col("verdict") == "matched").alias("m"), of(skill_gap).alias("g"), of(F.col("verdict") == "blocked").alias("b"), of(F.col("verdict").isin("unmet", "open")).alias("u"),
        F.sum(F.when(F.col("verdict") == "matched", F.col("weight")).otherwise(0)).alias("matched_weight"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"])).alias("labels"),
    )
    rows = postings.select("job_id", "title", "company", "years_min").join(per, "job_id", "left")
    count = lambda x: F.coalesce(F.size(x), F.lit(0))
    domains = [d.strip() for d in str(c.attested.get("avoid_domains") or "").split(",") if d.strip()]
    blob = matcher_norm(F.concat_ws(" ", "labels", "title", "company"))
    avoided = F.filter(F.array(*map(F.lit, domains)).cast("array<string>"), lambda d: blob.contains(matcher_norm(d)))
    policy = F.coalesce(*[F.when(F.replace(matcher_norm(F.col("company")), F.lit(" "), F.lit("")) == k, v) for k, v in REVIEWED_COMPANIES.items()])
    penalty, family = seniority_penalty(F.col("title"), F.lit(c.years)), role_family(F.col("title"))
    years, own = F.col("years_min"), F.lit(float(c.years))
    matched, weight = count(F.col("m")), F.coalesce("matched_weight", F.lit(0))
    open_ = count(F.col("u")) + F.size(avoided) + F.when(policy.isNotNull(), 1).otherwise(0)
    enough = (family_score(family) > 0) & (penalty == 0) & ((matched >= ENOUGH_MATCHES) | (weight >= ENOUGH_WEIGHT))
    action = (
        F.when(count(F.col("b")) > 0, "SKIP_HARD").when(open_ > 0, "REVIEW").when((years >= YEARS_OUT) & (own < years), "SKIP").when(weight == 0, "REVIEW")
        .when((years >= YEARS_GAP) & (own + YEARS_TOLERANCE < years), "STRETCH").when(enough, "APPLY").otherwise("REVIEW")
    )
    more = F.array_compact(F.array(F.when(F.size(avoided) > 0, "avoid_domain_match"), policy, F.when(penalty > 0, "seniority_mismatch"), F.when((count(F.col("b")) == 0) & (open_ == 0) & (weight == 0) & ~F.coalesce((years >= YEARS_OUT) & (own < years), F.lit(False)), "no_positive_match_signal")))
    names = lambda x: F.coalesce(F.transform(x, lambda s: s["label"]), F.array().cast("array<string>"))
    return rows.select(
        "job_id", action.alias("action"), names(F.col("m")).alias("matched"), names(F.col("g")).alias("missing"), weight.cast("int").alias("matched_weight"), count(F.col("g")).alias("missing_weight"), names(F.col("b")).alias("blocked_by"),
        F.concat(names(F.col("u")), avoided, F.array_compact(F.array(policy))).alias("unresolved"), F.array_sort(F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), more))).alias("reasons"), family.alias("role_family"), family_score(family).alias("family_score"), penalty.alias("seniority_penalty"),
    )


def _best_first() -> list[Column]:
    order = F.array_position(F.array(*map(F.lit, ACTION_ORDER)), F.col("action"))
    return [order.desc(), F.desc("family_score"), F.asc("seniority_penalty"), F.desc("matched_weight"), F.asc("missing_weight"), F.size("unresolved").asc(), F.asc("job_id")]


def ranked(decisions: DataFrame) -> DataFrame:
    """Decisions best first."""
    return decisions.orderBy(*_best_first())


def with_rank(decisions: DataFrame, n: int = 1000) -> DataFrame:
    """The best ``n`` decisions with their rank (R57); only the top of the order meets in one task."""
    from pyspark.sql import Window

    return decisions.orderBy(*_best_first()).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*_best_first())))
