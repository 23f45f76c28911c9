"""Records through successive snapshots, and the sources they come from: diffs, merges, states, schedules, roll-ups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import backoff
from tessera.operators.relational import first_per_group
from tessera.operators.selection import beside, quantiles

# Seconds between polls by tier, and limits of the schedule.
INTERVALS = {"A": 900, "B": 3600, "dormant": 10800}
DEAD_INTERVAL, OTHER_INTERVAL, LONGEST, SHORTEST = 604800, 3600, 21600, 60
EMPTY_DAYS, FAILURES, NOT_FOUND = 30, 5, 2


def usable(snapshots: DataFrame) -> DataFrame:
    """Fetched rows of sources whose fetch was complete and brought something new."""
    return snapshots.where("complete AND NOT unchanged").drop("complete", "unchanged")


def complete_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the pages of a source hold as many rows as it said there are."""
    return pages.groupBy(*keys).agg(F.count("*").alias("rows"), F.max("total").alias("total"), (F.count("*") == F.max("total")).alias("complete"))


def merge(current: DataFrame, fetched: DataFrame, sources: DataFrame, as_of: Column, expiry: bool = True) -> DataFrame:
    """The next version of the records.

    ``current``: source, key, hash, text, status (ok or pending), first_seen, last_seen, expired_at, seen_count.
    ``fetched``: source, key, hash, text, status.  ``sources``: the sources whose fetch is usable; records of
    others stay as they are, so an incomplete fetch never expires anything (I03).  A pending text never replaces an ok one.
    """
    polled = sources.select("source").distinct().withColumn("polled", F.lit(True))
    both = current.alias("c").join(fetched.join(polled, "source", "left_semi").alias("f"), ["source", "key"], "full").join(polled, "source", "left")
    new, missing, back = F.col("c.hash").isNull(), F.col("f.hash").isNull(), F.col("c.expired_at").isNotNull()
    changed = ~F.col("f.hash").eqNullSafe(F.col("c.hash")) | back
    replace = new | (~missing & changed & ~((F.col("f.status") == "pending") & (F.col("c.status") == "ok")))
    take = lambda c: F.when(replace, F.col(f"f.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
    gone = missing & F.coalesce(F.col("polled"), F.lit(False)) & F.lit(expiry)
    return both.select(
        "source", "key", take("hash"), take("text"), take("status"), F.coalesce(F.col("c.first_seen"), as_of).alias("first_seen"),
        F.when(missing, F.col("c.last_seen")).otherwise(as_of).alias("last_seen"),
        F.when(~missing, F.lit(None)).when(gone, F.coalesce(F.col("c.expired_at"), as_of)).otherwise(F.col("c.expired_at")).alias("expired_at"),
        (F.coalesce(F.col("c.seen_count"), F.lit(0)) + F.when(missing, 0).otherwise(1)).alias("seen_count"),
    )


def split_backfill(current: DataFrame, recomputed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose content hash changes, and those of which only the version is brought up to date."""
    both = recomputed.alias("n").join(current.alias("o"), key)
    same = F.col("n.hash").eqNullSafe(F.col("o.hash"))
    return both.where(~same).select("n.*"), both.where(same).select(key, "n.version")


def step(state: dict, ok: bool, code: int | None, found: int | None, now: datetime) -> dict:
    """The state of a source after one poll (I04): status, tier, failures, not_found, empty_since."""
    s = dict(state)
    if not ok:
        s["not_found"] = s["not_found"] + 1 if code in (404, 410) else 0
        s["failures"] += 1
        s["status"] = "dead" if s["not_found"] >= NOT_FOUND else "failing" if s["failures"] >= FAILURES else s["status"]
        return s
    s["failures"] = s["not_found"] = 0
    if found:
        return s | {"status": "live", "tier": "B" if s["tier"] == "dormant" else s["tier"], "empty_since": None}
    s["empty_since"] = s["empty_since"] or now
    dormant = now - s["empty_since"] >= timedelta(days=EMPTY_DAYS)
    return s | ({"status": "dormant", "tier": "dormant"} if dormant else {"status": "empty"})


START = {"status": "live", "tier": "B", "failures": 0, "not_found": 0, "empty_since": None}


def source_states(polls: DataFrame) -> DataFrame:
    """The state of each source after all its polls (source, at, poll, ok, code, found) in the order of at and poll.

    What ``step`` does poll by poll follows from a few marks of a source: its last successful poll, its last one that found
    something and its last one that wasn't a 404 or 410 (maxima), how many polls came after each and when it was first empty
    since (counts and a minimum), and its last ``FAILURES`` polls, for a source with fewer failures in a row can be dead
    from two of them.  All are partial sums, so no task walks through the polls of a source; a null ``ok`` is a failure.
    """
    ok = F.coalesce("ok", F.lit(False))
    gone = ~ok & F.coalesce(F.col("code").isin(404, 410), F.lit(False))
    some = ok & F.coalesce(F.col("found") != 0, F.lit(False))
    rows = polls.select("source", F.struct("at", "poll").alias("when"), ok.alias("ok"), gone.alias("gone"), some.alias("some"))
    marks = rows.groupBy("source").agg(
        F.max(F.when(F.col("ok"), F.col("when"))).alias("last_ok"), F.max(F.when(F.col("some"), F.col("when"))).alias("last_some"), F.max(F.when(~F.col("gone"), F.col("when"))).alias("last_other"), F.count("*").alias("polls")
    )
    after = lambda mark: F.col(mark).isNull() | (F.col("when") > F.col(mark))
    since = rows.join(marks, "source").groupBy("source").agg(
        F.count_if(after("last_ok")).cast("int").alias("failures"), F.count_if(after("last_other")).cast("int").alias("not_found"), F.min(F.when(F.col("ok") & ~F.col("some") & after("last_some"), F.col("when.at"))).alias("empty_since")
    )
    latest = first_per_group(rows, ["source"], [F.desc("when")], FAILURES)
    gone_lately = latest.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_in_group", "gone"))), lambda x: x["gone"]).alias("gone"))
    dormant = F.coalesce(F.col("last_ok.at") - F.col("empty_since") >= F.make_dt_interval(days=F.lit(EMPTY_DAYS)), F.lit(False))
    base = F.when(F.col("last_ok").isNull() | F.col("last_ok").eqNullSafe(F.col("last_some")), START["status"]).when(dormant, "dormant").otherwise("empty")
    pairs = F.zip_with(F.slice("gone", F.lit(1), F.greatest(F.col("failures") - 1, F.lit(0))), F.slice("gone", F.lit(2), F.greatest(F.col("failures") - 1, F.lit(0))), lambda x, y: x & y)
    status = F.when(F.col("failures") == 0, base).when(F.col("not_found") >= NOT_FOUND, "dead").when(F.col("failures") >= FAILURES, "failing").when(F.exists(pairs, lambda x: x), "dead").otherwise(base)
    found = marks.join(since, "source").join(gone_lately, "source")
    return found.select("source", status.alias("status"), F.when(dormant, "dormant").otherwise(START["tier"]).alias("tier"), "failures", "not_found", "empty_since", "polls")


def failure_streaks(polls: DataFrame) -> DataFrame:
    """polls with the number of failures in a row up to each one, as gaps and islands; no Python."""
    order = Window.partitionBy("source").orderBy("at", "poll")
    islands = polls.withColumn("island", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(order))
    within = Window.partitionBy("source", "island").orderBy("at", "poll")
    return islands.withColumn("failures", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(within)).drop("island")


def next_interval(tier: Column, status: Column, failures: Column) -> Column:
    """Seconds until the next poll, without jitter."""
    by_tier = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in INTERVALS.items() for x in kv]), tier), F.lit(OTHER_INTERVAL)).cast("bigint")
    return F.greatest(F.lit(SHORTEST).cast("bigint"), F.when(status == "dead", DEAD_INTERVAL).when(failures >= FAILURES, backoff(failures, 900, LONGEST)).otherwise(by_tier))


def claim_due(boards: DataFrame, as_of: Column, limit: int, p95_ms: Column) -> DataFrame:
    """The next sources to poll, A before B before others, each with the end of its lease."""
    due = boards.where((F.col("next_poll_at") <= as_of) & ((F.col("status") != "dead") | (F.col("last_seen") <= as_of - F.expr("INTERVAL 7 DAYS"))))
    rank = F.when(F.col("tier") == "A", 0).when(F.col("tier") == "B", 1).otherwise(2)
    lease = F.greatest(F.lit(900.0), 3 * F.coalesce(p95_ms, F.lit(0.0)) / 1000)
    return due.orderBy(rank, F.asc_nulls_last("next_poll_at"), "source").limit(limit).withColumn("lease_seconds", lease)


def choose_details(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """detail for the first ``cap`` rows of each source, pending for those beyond."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("fetch", F.when(F.row_number().over(w) <= cap, "detail").otherwise("pending"))


def retry_due(rows: DataFrame, as_of: Column) -> DataFrame:
    """Pending rows whose next attempt is due, never-tried ones first, with the delay after this one."""
    due = rows.where(F.col("next_attempt").isNull() | (F.col("next_attempt") <= as_of))
    return due.withColumn("delay_seconds", backoff(F.col("attempts"), 60, LONGEST)).orderBy(F.asc_nulls_first("next_attempt"))


def run_rollup(polls: DataFrame, keys: list[str]) -> DataFrame:
    """Counters and latency percentiles of each run."""
    counters = polls.groupBy(*keys).agg(
        F.count("*").alias("polls"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_distinct("source").alias("sources"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"),
    )
    return beside(counters, keys, quantiles(polls, keys, F.col("latency"), {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95)}))


#: States that a poll of a run ends in, and what is summed over its polls.
RUN_STATUSES = ["ok", "not_modified", "unchanged_hash", "empty", "failed", "dead"]
RUN_SUMS = ["new_jobs", "updated_jobs", "expired_jobs", "reappeared_jobs", "detail_fetches"]


def run_counters(polls: DataFrame, keys: list[str]) -> DataFrame:
    """The whole row of a finished run: polls (status, latency, RUN_SUMS) by status, sums, and latencies that were measured."""
    counters = polls.groupBy(*keys).agg(F.count("*").alias("boards_polled"), *[F.count_if(F.col("status") == s).alias(s) for s in RUN_STATUSES], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in RUN_SUMS])
    measured = F.when(F.col("latency") >= 0, F.col("latency"))
    return beside(counters, keys, quantiles(polls, keys, measured, {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95)}))


def reuse_active(jobs: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The latest queued or running job of each key."""
    return first_per_group(jobs.where(F.col("status").isin("queued", "running")), [key], order)


def batches_of_keys(df: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """The next rows of a resumable pass, by key."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(size)


def states_over(states: Iterator[dict]) -> list[dict]:
    """All states of a list of polls; for tests and small replays."""
    out, state = [], dict(START)
    for p in states:
        state = step(state, **p)
        out.append(state)
    return out
