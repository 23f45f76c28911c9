"""A pass that stops half way and goes on."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import backfill as B


def test_a_pass_that_stops_and_fails_has_every_row_once(spark, tmp_path):
    top = f"{tmp_path}/pass"
    rows = [(None, "null")] * 2 + [(i * i % 97, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, t string")
    work = lambda d: d.withColumn("n", F.length("t"))
    left = B.advance(df, "k", work, top, ranges=5, most=2)
    plan = B.planned(df, "k", top, 5)
    assert left == len(plan) - 2 > 0 and 0 < B.result(spark, top).count() < len(rows)

    def fails(d):
        work(d).limit(1).write.parquet(f"{top}/out/range={plan[2][0]}")  # as a task that was lost would leave it
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        B.advance(df, "k", fails, top, ranges=5)
    before = {r.range for r in B.done(spark, top).collect()}
    assert B.advance(df, "k", work, top, ranges=99) == 0  # the plan that was written holds
    assert before == {plan[0][0], plan[1][0]} and Counter(tuple(r)[:2] for r in B.result(spark, top).collect()) == Counter(rows)
    assert sum(r.rows for r in B.done(spark, top).collect()) == len(rows) and B.advance(df, "k", fails, top) == 0


def test_an_empty_table(spark, tmp_path):
    assert B.advance(spark.createDataFrame([], "k long"), "k", lambda d: d, f"{tmp_path}/none", ranges=3) == 0 and B.result(spark, f"{tmp_path}/none").count() == 0
