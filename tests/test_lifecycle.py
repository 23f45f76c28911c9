"""Diffs, merges, source states and the streaming sink."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import lifecycle as L
from tessera.operators import relational as R
from tessera.streaming import boards
from tessera.streaming import events as S

DAY = datetime(2024, 1, 1)


def keys(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "k string")


def test_diff_is_disjoint_and_complete(spark):
    got = dict(R.diff(keys(spark, "new", "present", "back"), keys(spark, "present", "missing"), keys(spark, "back", "old"), "k").collect())
    assert got == {"new": "new", "present": "present", "missing": "missing", "back": "reappeared"}


POLLS = "source string, at timestamp_ntz, poll long, ok boolean, code int, found double"


def folded(rows):
    """The states of all sources, poll by poll."""
    states = {}
    for source, at, poll, ok, code, found in sorted(rows, key=lambda x: (x[1], x[2])):
        n, state = states.get(source, (0, L.START))
        states[source] = n + 1, L.step(state, bool(ok), code, found, at)
    return {s: (*x.values(), n) for s, (n, x) in states.items()}


def polls_of(r, sources, n, step_hours):
    rows = []
    for i in range(n):
        source = "hot" if r.random() < 0.3 else f"s{r.randrange(sources)}"
        ok = r.random() < 0.45
        rows.append((source, DAY + timedelta(hours=step_hours * (i // 2)), i, None if r.random() < 0.02 else ok, None if ok else r.choice([404, 410, 500, None]), r.choice([0.0, 0.0, 0.0, 3.0, None]) if ok else None))
    return rows


def test_states_known_by_hand():
    state = lambda *polls: list(folded([("s", DAY + timedelta(days=d), i, ok, code, found) for i, (d, ok, code, found) in enumerate(polls)]).values())[0][:2]
    assert state((0, False, 404, None)) == ("live", "B") and state((0, False, 404, None), (0, False, 410, None)) == ("dead", "B")
    assert state(*[(0, False, 500, None)] * 5) == ("failing", "B") and state((0, False, 404, None), (0, False, 404, None), (0, False, 500, None)) == ("dead", "B")
    assert state((0, True, 200, 0), (31, True, 200, 0)) == ("dormant", "dormant") and state((0, True, 200, 0), (31, True, 200, 0), (32, True, 200, 1)) == ("live", "B")


def test_states_are_those_of_the_walk(spark):
    rows = [x for seed, (sources, hours) in enumerate([(60, 1), (300, 40), (40, 300)]) for x in [(f"{seed}{s}", *rest) for s, *rest in polls_of(random.Random(seed), sources, 900, hours)]]
    got = {r.source: tuple(r)[1:] for r in L.source_states(spark.createDataFrame(rows, POLLS).repartition(3)).collect()}
    want = folded(rows)
    assert got == want and {x[0] for x in want.values()} == {"live", "empty", "dormant", "failing", "dead"}
    assert L.source_states(spark.createDataFrame([], POLLS)).count() == 0


def test_stream_of_states_is_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = polls_of(random.Random(9), 6, 240, 20)
    polls = spark.createDataFrame(rows, POLLS)
    for k in range(3):  # later files hold later polls
        spark.createDataFrame(rows[k * 80 : k * 80 + 80], POLLS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(polls.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    try:
        boards.board_states(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(f"{tmp_path}/out").withColumn("empty_since", F.col("empty_since").cast("timestamp_ntz"))
    last = out.where("event = 'polled'").groupBy("source").agg(F.max_by(F.struct("status", "tier", "failures", "not_found", "empty_since", "polls", "next_seconds"), "polls").alias("x")).select("source", "x.*")
    want = L.source_states(polls).withColumn("next_seconds", L.next_interval(F.col("tier"), F.col("status"), F.col("failures")))
    assert sorted(map(str, last.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert out.where("event = 'due'").count() > 0


def test_intervals(spark):
    rows = [("A", "live", 0), ("B", "live", 0), ("dormant", "dormant", 0), ("B", "failing", 5), ("A", "dead", 9), ("C", "live", 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tier string, status string, failures int")
    got = [r.s for r in df.select("i", L.next_interval(F.col("tier"), F.col("status"), F.col("failures")).alias("s")).orderBy("i").collect()]
    assert got == [900, 3600, 10800, 21600, 604800, 3600]


SNAPSHOT = "source string, key string, hash string, text string, status string, complete boolean, unchanged boolean"


def test_merge_by_stream_is_safe_against_incomplete_and_repeated_batches(spark, tmp_path):
    top, landed = str(tmp_path / "records"), str(tmp_path / "landed")
    batches = [
        [("a", "1", "h1", "t1", "ok", True, False), ("a", "2", "h2", "t2", "ok", True, False), ("b", "9", "h9", "t9", "ok", True, False)],
        [("a", "1", "h1x", "", "pending", True, False), ("b", "8", "h8", "t8", "ok", False, False)],  # b is incomplete; 2 is gone
        [("a", "1", "h1y", "t1y", "ok", True, False), ("a", "2", "h2", "t2", "ok", True, False)],
    ]
    save = S.merge_sink(top, lambda epoch: f"2024-01-0{epoch + 1}")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{landed}/d{i}")
        df = spark.read.parquet(f"{landed}/d{i}")
        save(df, i)
        save(df, i)  # the same batch again
    v2 = {(r.source, r.key): r for r in spark.read.parquet(f"{top}/v2").collect()}
    assert set(v2) == {("a", "1"), ("a", "2"), ("b", "9")}
    assert v2["a", "1"].text == "t1" and v2["a", "1"].seen_count == 2 and v2["a", "2"].expired_at == datetime(2024, 1, 2) and v2["b", "9"].expired_at is None
    v3 = {(r.source, r.key): r for r in spark.read.parquet(f"{top}/v3").collect()}
    assert v3["a", "1"].text == "t1y" and v3["a", "2"].expired_at is None and v3["a", "2"].first_seen == datetime(2024, 1, 1) and v3["a", "2"].seen_count == 2


def test_claims_details_and_retries(spark):
    now = F.lit("2024-01-10").cast("timestamp_ntz")
    at = lambda d: datetime(2024, 1, d)
    boards = spark.createDataFrame([("c", "C", "live", at(1), None), ("a", "A", "live", at(9), None), ("x", "A", "dead", at(1), at(9)), ("y", "B", "dead", at(1), at(2)), ("z", "A", "live", at(20), None)], "source string, tier string, status string, next_poll_at timestamp_ntz, last_seen timestamp_ntz")
    assert [r.source for r in L.claim_due(boards, now, 5, F.lit(None).cast("double")).collect()] == ["a", "y", "c"]
    rows = spark.createDataFrame([("a", i) for i in range(5)], "s string, n int")
    assert sorted(r.fetch for r in L.choose_details(rows, ["s"], [F.asc("n")], 3).collect()) == ["detail"] * 3 + ["pending"] * 2
    pending = spark.createDataFrame([(1, 3, at(1)), (2, 0, None), (3, 0, at(11))], "i int, attempts int, next_attempt timestamp_ntz")
    assert [(r.i, r.delay_seconds) for r in L.retry_due(pending, now).collect()] == [(2, 60), (1, 480)]
    jobs = spark.createDataFrame([("k", "running", 1), ("k", "queued", 2), ("k", "failed", 3)], "k string, status string, n int")
    assert [r.n for r in L.reuse_active(jobs, "k", [F.desc("n")]).collect()] == [2]


def test_table_maintenance(spark):
    current = spark.createDataFrame([("a", 1, 2), ("b", 1, 1)], "k string, v int, seen int")
    incoming = spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int")
    got = sorted(map(tuple, R.upsert(current, incoming, "k", {"v": F.col("i.v"), "seen": F.col("c.seen") + 1}, {"v": F.col("i.v"), "seen": F.lit(1)}).collect()))
    assert got == [("a", 1, 2), ("b", 5, 2), ("c", 6, 1)]
    again = spark.createDataFrame([("b", 5), ("c", 6), ("c", 7)], "k string, v int")
    assert [tuple(r) for r in R.insert_absent(current, again, "k", [F.asc("v")]).collect()] == [("c", 6)]
    assert sorted(r.v for r in R.replace_slice(current.select("k", "v"), incoming, F.col("k") == "a").collect()) == [1, 5, 6]
    good, bad = R.validated(spark.createDataFrame([("x",), (None,), ("y",)], "s string"), "s", ["x"])
    assert good.count() == 1 and {r.error for r in bad.collect()} == {"invalid s: null", "invalid s: y"}
    assert R.older_than(F.lit(None), F.current_timestamp()) is not None and R.sampled(current, "k", 1, 3).count() == 1
    found = current.where(R.any_contains(["k"], ["A", "c++"]))
    assert [r.k for r in found.collect()] == ["a"]


def test_evidence_decisions_by_table(spark):
    from tessera.operators import evidence as E
    from tessera.plans.postings import REQUIREMENTS as _REQ

    schema = f"job_id string, title string, company string, years_min double, hard {_REQ}, preferred {_REQ}"
    req = lambda kind, value, state="VERIFIED": (kind, value, None, None, value, state)
    rows = [
        ("hard", "Backend Engineer", "acme", 1.0, [req("clearance", "active secret clearance")], []), ("none", "Gardener", "acme", None, [], []), ("policy", "Backend Engineer", "Anduril Industries", None, [req("skill", "Python")], []),
        ("person", "Backend Engineer", "acme", None, [req("citizenship", "must be a US person"), req("skill", "Python")], []), ("degree", "Backend Engineer", "acme", None, [req("education", "Bachelor degree"), req("skill", "Python")], []),
        ("place", "Backend Engineer", "acme", None, [req("location", "onsite in London")], []), ("remote", "Backend Engineer", "acme", None, [req("location", "remote")], [req(None, "Python")]), ("wish", "QA Engineer", "acme", None, [], [req(None, "Rust"), req(None, "python")]),
    ]
    postings = spark.createDataFrame(rows, schema)
    c = E.Candidate(skills={"Python": 9}, text="Python, B.S.", years=1.66, attested={"citizenship": "India", "us_person": False, "security_clearance": "none", "current_location": "Seattle", "avoid_domains": "gambling"})
    got = {r.job_id: r for r in E.decide(postings, c).collect()}
    assert got["person"].action == "SKIP_HARD" and got["person"].blocked_by == ["must be a US person"]
    assert got["degree"].action == "REVIEW" and got["degree"].unresolved == [] and got["degree"].matched == ["Python"]
    assert got["place"].action == "REVIEW" and got["place"].unresolved == ["onsite in London"] and got["remote"].unresolved == []
    assert (got["wish"].matched, got["wish"].missing, got["wish"].role_family, got["wish"].family_score) == (["python"], ["Rust"], "qa", -3)
    assert got["hard"].action == "SKIP_HARD" and got["none"].reasons == ["no_positive_match_signal"] and got["policy"].reasons == ["company_defense_or_export_control_risk"]
    assert [r.job_id for r in E.ranked(E.decide(postings, c)).limit(1).collect()] != ["hard"]
