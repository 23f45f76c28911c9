"""Decision tables for text functions, sources, sinks and scalar rules."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import ontology as O
from tessera.functions import text as T
from tessera.functions.experience import entry_experience
from tessera.operators import scoring as S
from tessera.sources import records, sinks


def values(spark, expr, xs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_urls_are_canonical(spark):
    urls = ["HTTPS://Jobs.Example.COM/a/?utm_source=x&ref=y&foo=bar#top", "https://x.com/a?gh_jid=7&foo=bar", "https://x.com/", " not a url/ ", "", None, "https://x.com/a?b=c d&e", "https://x.com/p?q=%C3%A9~*"]
    assert values(spark, T.canonical_url, urls) == ["https://jobs.example.com/a?foo=bar", "https://x.com/a?gh_jid=7", "https://x.com", "not a url", None, None, "https://x.com/a?b=c+d&e=", "https://x.com/p?q=%C3%A9~%2A"]


def test_keys_prefer_urls_and_drop_places(spark):
    row = spark.range(1)
    key = lambda u, c, t, p: T.identity_key(*[F.lit(x).cast("string") for x in (u, c, t, p)])
    queue = lambda t: T.queue_key(F.lit("Acme, Inc."), F.lit(t), F.lit("other"))
    got = row.select(key("https://x.com/1", "A", "B", None).alias("a"), key(None, "Acme Inc.", "Engineer", "NYC").alias("b"), key(None, None, "Engineer", None).alias("c"), queue("Engineer - Austin, TX, USA").alias("d"), queue("Engineer").alias("e"), queue("").alias("f")).first()
    assert tuple(got) == ("url:https://x.com/1", "role:acme inc|engineer|nyc", None, "queue:acme inc|engineer", "queue:acme inc|engineer", "other")


@pytest.mark.parametrize(
    "source, want",
    [
        ("<div><h2>About</h2><p>We build.</p><ul><li>one</li><li>two</li></ul></div>", "## About\n\nWe build.\n\n- one\n- two"), ("<h2></h2><p><b>&nbsp;</b></p>", ""), (f"<p><b>{'word ' * 60}</b></p>", ("word " * 60).strip()),
        ("<p><strong>Benefits</strong></p><p>Many&nbsp;  things.</p>", "## Benefits\n\nMany things."), (f"<h2>{'longer ' * 25}</h2>", ("longer " * 25).strip()), ("&lt;p&gt;escaped&lt;/p&gt;", "escaped"), (None, ""), ("just text", "just text"), ("<script>x()</script><p>a<br>b</p>", "a b"),
    ],
)
def test_html_becomes_text(source, want):
    assert H.to_text(source) == want


def test_html_columns(spark):
    assert values(spark, H.html_to_text, ["<p>a</p>", None]) == ["a", ""]
    assert [[b.kind for b in x] for x in values(spark, H.html_blocks, ["<h1>t</h1><ul><li>a</li></ul>"])] == [["heading", "item"]]


def test_experience_of_whole_postings(spark):
    table = {
        "No experience required": "0 years", "1+ year of experience": "1 year", "1-2 years of experience": "1–2 years", "2 years of experience": "2 years", "Minimum 2 years of experience": None, "2+ years of experience": None, "At least 2 years of experience": None,
        "2 years minimum of experience": None, "3+ years of experience": None, "1+ year of experience\n2+ years of experience": None, "We like people": None, "": None,
        "Minimum experience: 2 years": None, "2 years of experience minimum": None, "2 to 2 years of experience": "2 years", "experience of 1 year, or 1-2 years of other experience": "1 year", "12 years of experience": None, "minimum 1 year of experience": "1 year", None: None,
    }
    assert dict(zip(table, values(spark, entry_experience, list(table)))) == table


def test_html_nesting_has_no_limit():
    assert H.to_text("<div>" * 20000 + "<p>deep</p>" + "</div>" * 20000) == "deep"


def test_claims_companies_and_addresses(spark):
    claims = lambda x: T.unsupported_claims(x, F.array(F.lit("Led 5 people"), F.lit("from 200 ms to 50 ms")))
    got = values(spark, claims, ["Led 5 people, 75% faster for 3 years " + "x" * 3000 + " at scale", None, ""])
    assert [(c.kind, c.span) for c in got[0]] == [("scale", "at scale"), ("duration", "3 years")] or {c.span for c in got[0]} == {"at scale", "3 years"}
    assert values(spark, T.display_company, ["capitalone", "acme  corp", "x.myworkdayjobs.com|Big_Site-One", "x.myworkdayjobs.com|own|External", None]) == ["Capital One", "Acme Corp", "Big Site One", "Own", None]
    urls = ["https://x.wd1.myworkdayjobs.com/en/job/Austin-TX/Dev", "https://x.com/job/London/Dev", "https://x.com/job/USA---Remote/Dev?x=1", "https://x.com/jobs/TX/1", None, "https://x.com/job/New_York_City/d"]
    assert values(spark, S.us_url, urls) == [True, False, True, False, False, True]
    assert values(spark, T.escape_latex, ["a_b & 5% ~"]) == [r"a\_b \& 5\% \textasciitilde{}"]
    assert [r.n for r in spark.range(1).select(T.token_estimate(F.lit("abcdefgh"), F.lit(100)).alias("n")).collect()] == [102]


def test_labels_buckets_and_salaries(spark):
    labels = ["New grad", "0 years", "1–2 years", "2 years", "1+ years", "2+ years", "3+ years", "3–5 years", "6+ years", "10 years", "Not stated", "", "wordy"]
    assert values(spark, T.experience_bucket, labels) == ["early", "early", "early", "early", "one-plus", "two-plus", "three-plus", "mid", "senior", "senior", "unknown", "unknown", "unknown"]
    assert values(spark, T.experience_label, ["2+ years of experience", "experience of 1 year", None, "no experience required"]) == ["2+ years", "1 year", "Not stated", "0 years"]
    assert values(spark, T.salary, ["pay $120,000 - $155,000", "$45/hr", "none", None]) == ["$120,000 - $155,000", "$45/hr", "", ""]
    assert values(spark, T.metric_facts, ["200 ms -> 50 ms, 5 ms -> 9 ms"]) == [["75% reduction"]]


def test_small_expressions(spark):
    assert values(spark, T.compact, ["  a  b\n", None]) == ["a b", ""]
    assert values(spark, T.title_case, ["new-york o'neil"]) == ["New-York O'Neil"]
    assert values(spark, T.bool_text, [" True", "false", "x", None]) == ["true", "false", "x", None]
    assert values(spark, T.escape_pipe, ["a|b\nc"]) == ["a\\|b c"] and values(spark, T.escape_html, ['<a b="c">&']) == ["&lt;a b=&quot;c&quot;&gt;&amp;"]
    assert values(spark, T.json_body, ['```json\n{"a": {"b": 1}}\n```', "no"]) == ['{"a": {"b": 1}}', None]
    assert values(spark, T.company_slugs, ["Smith & Co."])[0][:3] == ["smith-and-co", "smithandco", "smith_and_co"]
    assert values(spark, T.parse_moment, ["1700000000000", "2024-01-02T03:04:05Z", "January 2, 2024", "Jan 2, 2024", "soon"]) == [datetime(2023, 11, 14, 22, 13, 20), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2), datetime(2024, 1, 2), None]
    ages = [datetime(2024, 1, 1, 0, 0), datetime(2023, 12, 31, 23, 2), datetime(2023, 12, 31, 20), datetime(2023, 12, 30)]
    assert values(spark, lambda x: T.age_label(x, F.lit("2024-01-01 00:00:30").cast("timestamp")), ages, "timestamp") == ["just now", "58 min ago", "4 hours ago", "2 days ago"]


def test_ontology(spark):
    assert values(spark, O.canonical, ["Postgres", "CI/CD", "K8s", "Unknown  Thing"]) == ["postgresql", "ci/cd", "kubernetes", "unknown thing"]
    got = values(spark, O.requirement_terms, ["TS/Node", "FastAPI or postgres", "experience with c++ code", "c++"])
    assert {"typescript", "node.js"} <= set(got[0]) and {"fastapi", "postgresql"} <= set(got[1]) and "c++" not in got[2] and "c++" in got[3]
    expand = lambda t: {r.term for r in O.expanded(spark.createDataFrame([(t,)], "t string"), "t").collect()}
    assert {"fastapi", "python", "backend"} <= expand("FastAPI") and "fastapi" not in expand("python") and "mongodb" not in expand("postgres")


def test_places_and_titles(spark):
    assert values(spark, S.in_us, ["Redlands, CA", "Remote - United States", "Toronto", "Prague, Czech Republic", None, "Toronto, Remote US"]) == [True, True, False, False, False, False]
    assert values(spark, lambda x: S.outside_us(x, F.lit(None).cast("string")), ["London, UK", "Austin, TX", "BR-Sao"]) == [True, False, True]
    titles = spark.createDataFrame([(t, p, d) for t, p, d in [("Field Sales Engineer", None, None), ("Software Engineer, Sales Platform", None, None), ("Software Engineer", "London", None), ("Software Engineer", "Remote - US", datetime(2020, 1, 1)), (None, None, None), ("Staff Engineer", None, None)]], "title string, location string, date_posted timestamp_ntz")
    got = S.filter_titles(titles, "v3", F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert [r.skip_reason for r in got] == ["role_head", None, "non_us_location", "stale_posting", "no_title_match", "seniority"]
    assert [r.matched_pattern for r in got] == [None, "swe_title", "swe_title", "swe_title", None, None]
    eligible = values(spark, lambda x: S.eligible_title(x, F.lit("")), ["Software Engineer", "Senior Software Engineer", "Member of Technical Staff, Senior", "Software Engineer III", "Nurse"])
    assert eligible == [True, False, True, False, False]


def test_scores(spark):
    words = F.array(F.lit("robotics"), F.lit("simulation"))
    row = spark.range(1).select(T.keyword_score(words, F.lit("Robotics Software Engineer"), F.lit("robotics simulation autonomy")).alias("k"), S.quality_score(F.lit(3), F.lit(1), F.lit("probable"), F.lit("green"), F.lit(4)).alias("q"), S.fallback_score(F.lit(9)).alias("f")).first()
    assert tuple(row) == (5, 63, 100)
    status, failed = S.preflight([(F.lit(True), "a"), (F.lit(None).cast("boolean"), "b")], F.lit(False))
    assert tuple(spark.range(1).select(status.alias("s"), failed.alias("f")).first()) == ("blocked", ["b"])
    safe = spark.range(1).select(*S.sanitized(F.lit("140"), F.lit("HIGH"), F.array(*map(F.lit, "abcde")), F.lit(None).cast("array<string>"))).first()
    assert tuple(safe) == (100, "high", ["a", "b", "c", "d"], [])


def test_payloads_become_records(spark):
    green = '{"jobs": [{"id": 7, "title": " Engineer ", "location": {"name": "NYC"}, "absolute_url": "https://x.com/7?ref=a", "updated_at": "2024-01-02T03:04:05Z", "content": "&lt;p&gt;Hi&lt;/p&gt;"}]}'
    lever = '[{"id": "a", "text": "Dev", "categories": {"location": "SF"}, "hostedUrl": "https://y.com/a", "createdAt": 1700000000000, "description": "<p>Top</p>", "lists": [{"text": "Needs", "content": "<li>x</li>"}], "additional": ""}]'
    raw = spark.createDataFrame([("greenhouse", "acme", green), ("lever", "acme", lever), ("ashby", "acme", '{"other": 1}'), ("workday", "w", '{"jobPostings": [{"title": "T", "jobReqId": "R1"}]}')], "source string, company string, payload string")
    got = {r.external_id: r for r in records.normalize_all(raw).collect()}
    assert set(got) == {"greenhouse_7", "lever_a", "workday_w_R1"}
    assert got["greenhouse_7"].canonical_url == "https://x.com/7" and got["greenhouse_7"].description_text == "Hi" and got["lever_a"].description_text == "Top\n\n## Needs\n\n- x" and got["workday_w_R1"].description_status == "pending"
    assert records.rows_of(raw.where("source = 'ashby'").select("company", "payload"), "ashby").first().error


def test_file_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿company_name,domain\nAcme,acme.com\n", encoding="utf-8")
    assert records.registry_csv(spark, str(tmp_path / "r.csv")).first().company_name == "Acme"
    text = spark.createDataFrame([('{"lever": ["A ", {"slug": "b"}, {"name": "C"}, ""], "odd": ["z"]}',)], "value string")
    assert sorted(map(tuple, records.config_pairs(text, ["lever"]).collect())) == [("lever", "a"), ("lever", "b"), ("lever", "c")]
    lines = spark.createDataFrame([("Acme|Dev|2020-01-01|present|full|x",), ("bad|line",)], "value string")
    (row,) = records.piped_records(lines).collect()
    assert row.is_current and row.end_date is None and str(row.start_date) == "2020-01-01"
    md = spark.createDataFrame([("| role | company |",), ("|---|---|",), ("| a \\| b | c |",), ("text",)], "value string")
    assert [tuple(r) for r in records.markdown_table(md, ["role", "company"]).collect()] == [("a | b", "c")]
    urls = spark.createDataFrame([("s", "https://boards.greenhouse.io/acme"), ("s", "https://jobs.lever.co/acme2"), ("t", "https://x.com")], "site string, url string")
    found = records.fingerprint(urls, [("greenhouse", r"greenhouse\.io/(\w+)", 20), ("lever", r"lever\.co/(\w+)", 25)])
    assert [tuple(r) for r in found.collect()] == [("s", "lever", "acme2", 25)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", "javascript:x"), ("c", "https://x")], "n string, url string")
    assert [r.value for r in sinks.markdown_lines(df).collect()] == ["| a\\|b |  |", "| c | https://x |"]
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_report({"one": df}, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2 == spark.read.json(str(tmp_path / "j/one")).count()
    assert sinks.replace_block("x\n<!-- t:start -->\nold\n<!-- t:end -->\ny", "t", ["new"]) == "x\n<!-- t:start -->\nnew\n<!-- t:end -->\ny"
    with pytest.raises(ValueError):
        sinks.replace_block("x", "t", [])


def test_blocks_make_up_the_text(spark):
    from tessera.functions import html as H

    sources = ["<h1>A &amp;amp; b</h1><p>one<br>two</p><ul><li>x<li>y</ul><div>z<script>no</script></div>", "plain &lt;b&gt;words", "", None, "<p><b>Short one</b></p>tail", "<br><br>"]
    pages = spark.createDataFrame(list(enumerate(sources)), "id int, html string")
    found = {}
    for r in sorted(H.page_blocks(pages, "id", "html").collect(), key=lambda r: r.pos):
        found.setdefault(r.id, []).append((r.kind, r.block))
    texts = {r.id: r.text for r in pages.select("id", H.html_to_text("html").alias("text")).collect()}
    assert all(H.joined(found.get(i, [])) == texts[i] for i in texts) and texts[0].startswith("## A & b") and not {2, 3} & found.keys()


def test_long_pages_go_to_python_a_few_at_a_time(spark):
    from pyspark.sql import functions as F

    from tessera.functions.expressions import small_batches

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    small_batches(spark)
    bounds = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.unset(n)

    @F.pandas_udf("long")
    def rows(x):
        return x.map(lambda _: len(x))

    from tessera.plans.catalogue import QUERIES

    QUERIES["q_html_text"](spark, "/root/testdata/sf0.001")
    assert [spark.conf.get(n) for n in names] == bounds
    pages = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("html"))
    assert pages.select(rows("html").alias("n")).agg(F.max("n")).first()[0] <= 120
