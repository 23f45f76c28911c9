"""Lookups, facets, fact tables and reports: nulls, ties, blanks and empty tables."""

from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import lifecycle as L
from tessera.operators import reports as X

NOW = datetime(2024, 1, 10)
CARDS = "id int, title string, company string, location string, salary string, bucket string, tier string, date_posted timestamp_ntz"


def cards(spark, *rows):
    return spark.createDataFrame(list(rows), CARDS)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_facets_hold_one_by_one_and_together(spark):
    df = cards(
        spark, (1, "Backend Engineer", "Acme", "Austin", "$100,000", "early", "Tier 1", datetime(2024, 1, 9, 1)), (2, "Nurse", "ACME", None, "", "mid", "Tier 3", datetime(2024, 1, 8)),
        (3, None, None, None, None, None, None, None), (4, "Engineer", "Other", "Acme Road", "$1", "early", "Tier 3", datetime(2024, 1, 7)),
    )
    now = F.lit(NOW).cast("timestamp_ntz")
    assert ids(X.facets(df, now)) == [1, 2, 3, 4]
    assert ids(X.facets(df, now, company=" acme ")) == [1, 2]
    assert ids(X.facets(df, now, keyword="Acme")) == [1, 2, 4]
    assert ids(X.facets(df, now, salary=True, bucket="early", tier="Tier 3")) == [4]
    # the 8th ends a second before the 9th begins, two days before the 10th is the 8th's beginning
    assert ids(X.facets(df, now, days=2)) == [1, 2]
    assert ids(X.facets(df, now, days=1)) == [1]
    assert X.facets(df.where("false"), now, days=1, keyword="x").count() == 0


def test_reasons_count_once_a_row(spark):
    df = spark.createDataFrame([("a", ["x", "x", "y"]), ("a", None), (None, [])], "c string, r array<string>")
    got = {(r.kind, r.name): r.n for r in X.category_counts(df, "c", "r").collect()}
    assert got == {("category", "a"): 2, ("category", None): 1, ("reason", "x"): 1, ("reason", "y"): 1}


def test_average_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 2.006)], "g string, x double")
    assert {r.g: r.m for r in df.groupBy("g").agg(X.average(F.col("x")).alias("m")).collect()} == {"a": 0.0, "b": 1.5}


def test_first_probe_that_found_something(spark):
    df = spark.createDataFrame([("k", 1, 0), ("k", 2, 5), ("k", 3, 9), ("none", 1, 0), ("null", 1, None)], "key string, pos int, found int")
    assert [tuple(r) for r in X.first_with_rows(df, ["key"], [F.asc("pos")], "found").collect()] == [("k", 2, 5)]


def test_careers_urls_in_order(spark):
    (row,) = spark.range(1).select(X.careers_urls(F.lit(" /Acme.COM/ ")).alias("u")).collect()
    assert row.u == ["https://acme.com/careers", "https://acme.com/jobs", "https://careers.acme.com", "https://jobs.acme.com", "https://www.acme.com/careers", "https://www.acme.com/jobs", "https://acme.com"]


def test_refresh_tells_what_changed(spark):
    rows = [(1, "skill", "Python", "We use Python.", "VERIFIED", ""), (2, "skill", "Python", "We use Python.", None, ""), (3, "skill", "Rust", "We use Python.", "VERIFIED", ""), (4, "skill", None, "x", "REJECTED", "no source_text"), (5, None, None, None, None, None)]
    got = {r.id: (r.state, r.changed) for r in X.refreshed(spark.createDataFrame(rows, "id int, kind string, quoted string, posting string, state string, note string")).collect()}
    assert got == {1: ("VERIFIED", False), 2: ("VERIFIED", True), 3: ("REJECTED", True), 4: ("REJECTED", False), 5: ("REJECTED", True)}


def test_fact_rows_keep_the_first_of_equal_ones(spark):
    rows = [("p", 2, 1, None, " Built it ", ["Go", " go", ""]), ("p", 2, 2, "ATTESTED", "built IT", None), ("p", 2, 3, "CONFLICTED", "never", ["Rust"]), ("q", None, 1, "ATTESTED", None, ["Go"])]
    got = sorted(tuple(r) for r in X.fact_rows(spark.createDataFrame(rows, "project string, weight int, pos int, tier string, claim string, technologies array<string>")).select("project", "key", "value", "tier").collect())
    assert got == [("p", "project_fact", "Built it", "OBSERVED"), ("p", "skill", "Go", "OBSERVED"), ("q", "skill", "Go", "ATTESTED")]


def test_profile_rows_by_section(spark):
    rows = [("Skills", "Go", "OBSERVED", 0), ("role:x", "SRE", None, None), ("degree", " BS ", "ATTESTED", 3), ("citizenship", "US", "ATTESTED", 1), ("citizenship", "US", "OBSERVED", 1), ("note", " ", "OBSERVED", 1), (None, "loose", "ATTESTED", 1)]
    got = sorted((r.section, r.value, r.weight) for r in X.profile_rows(spark.createDataFrame(rows, "key string, value string, tier string, weight int")).collect())
    assert got == [("education", "BS", 3), ("highlights", "US", 1), ("highlights", "loose", 1), ("preferred_roles", "SRE", 1), ("skills", "Go", 1)]


def test_early_career(spark):
    rows = [("Engineer", "early", True), ("<b>Senior</b> Engineer", "early", False), ("Engineer III", "early", False), ("Nurse", "early", False), ("New Grad Engineer", "unknown", True), ("Engineer", "unknown", False), ("Engineer", "mid", False), (None, "early", True), (None, None, False)]
    got = spark.createDataFrame(rows, "title string, bucket string, wanted boolean").select(X.early_career(F.col("title"), F.col("bucket")).alias("got"), "wanted").collect()
    assert [r.got for r in got] == [r.wanted for r in got]


def test_split_keywords(spark):
    (row,) = spark.range(1).select(T.split_keywords(F.lit("The (Go) go, C++.\tand  \n"), ["the", "and"], 2).alias("a"), T.split_keywords(F.lit(None).cast("string"), [], 1).alias("b")).collect()
    assert (row.a, row.b) == (["go", "c++"], [])


def test_run_counters_of_statuses_and_measured_latencies(spark):
    sums = ", ".join(f"{c} int" for c in L.RUN_SUMS)
    rows = [("r", "ok", 5.0, 1, 2, 3, 4, 5), ("r", "dead", -1.0, 1, None, 0, 0, 0), ("r", None, 9.0, 0, 0, 0, 0, 0)]
    (row,) = L.run_counters(spark.createDataFrame(rows, f"run string, status string, latency double, {sums}"), ["run"]).collect()
    assert (row.boards_polled, row.ok, row.dead, row.failed, row.new_jobs, row.updated_jobs, row.detail_fetches, row.p50, row.p95) == (3, 1, 1, 0, 2, 2, 5, 5.0, 9.0)


def test_coverage_of_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    got = X.coverage_report(
        empty("ats string, status string, confidence string, board_id int"), empty("ats string, status string, tier string, next_poll_at timestamp_ntz"), empty("source string, company string, first_seen timestamp_ntz, date_posted timestamp_ntz, expired_at timestamp_ntz, text string"),
        empty("run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, p50 double, p95 double, due int, polled int"), F.lit(NOW).cast("timestamp_ntz"), ["a"],
    ).collect()
    assert {r.section for r in got} == {"registry", "expired_jobs", "schedule"} and not any(r.value for r in got)


def test_early_page_tries_each_pattern_of_experience_once(spark):
    from tessera.plans.catalogue import QUERIES

    plan = QUERIES["q_early_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 9
