"""Registered queries over adjudicated requirements, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import adjudication as J
from tessera.plans.registry import query
from tessera.plans.relational import tab

_DECISIONS = """l AS (SELECT l_orderkey, l_linenumber, concat('r', l_linenumber, '-', l_partkey % 5) AS requirement, l_quantity >= 20 AS has, l_discount = 0 AS open, CASE WHEN l_tax >= 0.03 THEN 'MET' WHEN l_tax > 0 THEN 'UNMET' END AS verdict FROM lineitem),
    d AS (SELECT l_orderkey AS decision_id, list_sort(coalesce(list(requirement) FILTER (WHERE has), [])) AS matched, list_sort(coalesce(list(requirement) FILTER (WHERE NOT has), [])) AS missing, count(*) FILTER (WHERE has) AS matched_weight, count(*) FILTER (WHERE NOT has) AS missing_weight,
      count(*) FILTER (WHERE open) AS unresolved, CASE WHEN l_orderkey % 3 = 0 THEN 'SKIP' ELSE 'REVIEW' END AS action, list(requirement) FILTER (WHERE verdict = 'MET') AS met FROM l GROUP BY l_orderkey)"""


@query(
    "q_adjudicated",
    f"""WITH {_DECISIONS}, m AS (SELECT *, list_filter(missing, lambda x: list_contains(coalesce(met, []), x)) AS moved FROM d),
    a AS (SELECT decision_id, list_sort(list_concat(matched, moved)) AS matched, list_filter(missing, lambda x: NOT list_contains(moved, x)) AS missing, matched_weight + len(moved) AS matched_weight, greatest(0, missing_weight - len(moved)) AS missing_weight, unresolved, action, met FROM m)
    SELECT decision_id, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing, matched_weight, missing_weight, CASE WHEN met IS NOT NULL AND action = 'REVIEW' AND unresolved = 0 AND matched_weight > 0 AND len(matched) >= len(missing) THEN 'APPLY' ELSE action END AS action FROM a""",
)
def adjudicated(spark, sf_dir):
    """Decisions over orders, their lines being requirements, after the verdicts on these."""
    (lineitem,) = tab(spark, sf_dir, "lineitem")
    k, has = F.col("l_orderkey"), F.col("l_quantity") >= 20
    requirement = F.concat(F.lit("r"), F.col("l_linenumber").cast("string"), F.lit("-"), (F.col("l_partkey") % 5).cast("string"))
    lines = lineitem.select(k.alias("decision_id"), requirement.alias("requirement"), has.alias("has"), (F.col("l_discount") == 0).alias("open"), F.when(F.col("l_tax") >= 0.03, "MET").when(F.col("l_tax") > 0, "UNMET").alias("verdict"))
    decisions = lines.groupBy("decision_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("has"), F.col("requirement")))).alias("matched"), F.array_sort(F.collect_list(F.when(~F.col("has"), F.col("requirement")))).alias("missing"), F.count_if("has").alias("matched_weight"),
        F.count_if(~F.col("has")).alias("missing_weight"), F.count_if("open").alias("unresolved"), F.when(F.col("decision_id") % 3 == 0, "SKIP").otherwise("REVIEW").alias("action"),
    )
    after = J.apply_verdicts(decisions, lines.select("decision_id", "requirement", "verdict"))
    return after.select("decision_id", F.array_join(F.array_sort("matched"), ",").alias("matched"), F.array_join("missing", ",").alias("missing"), "matched_weight", "missing_weight", "action")


_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query(
    "q_preselected_facts",
    f"""WITH r AS (SELECT DISTINCT p_type AS requirement_id, p_type AS t FROM part), q AS (SELECT requirement_id, unnest({_TOKENS.format('t')}) AS token FROM r), f AS (SELECT p_partkey AS fact_id, p_size AS weight, unnest({_TOKENS.format("p_name || ' ' || p_type")}) AS token FROM part),
    m AS (SELECT requirement_id, fact_id, count(*) AS overlap, max(weight) AS weight FROM q JOIN f USING (token) GROUP BY 1, 2)
    SELECT requirement_id, fact_id, overlap, weight, row_number() OVER (PARTITION BY requirement_id ORDER BY overlap DESC, weight DESC NULLS LAST, fact_id) AS rank FROM m QUALIFY rank <= {J.FACTS}""",
)
def preselected_facts(spark, sf_dir):
    """For each kind of part, as a requirement, the parts whose words share most with it, the larger first."""
    (part,) = tab(spark, sf_dir, "part")
    tokens = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens")
    requirements = part.select(F.col("p_type").alias("requirement_id")).distinct().select("requirement_id", tokens(F.col("requirement_id")))
    facts = part.select(F.col("p_partkey").alias("fact_id"), F.col("p_size").alias("weight"), tokens(F.concat_ws(" ", "p_name", "p_type")))
    return J.preselected(requirements, facts)
