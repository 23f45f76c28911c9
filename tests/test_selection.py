"""Exact percentiles against sorted lists, whatever the sketch says."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.selection import quantiles

WANTED = {"c25": ("continuous", 0.25), "c95": ("continuous", 0.95), "n50": ("nearest", 0.5), "n95": ("nearest", 0.95), "n0": ("nearest", 0.0), "n1": ("nearest", 1.0), "i50": ("index", 0.5), "i95": ("index", 0.95)}


def by_sorting(values):
    x, n, out = sorted(values), len(values), []
    for kind, share in WANTED.values():
        at = share * (n - 1)
        if kind == "continuous":
            out.append(x[math.floor(at)] if at == math.floor(at) else (math.ceil(at) - at) * x[math.floor(at)] + (at - math.floor(at)) * x[math.ceil(at)])
        else:
            out.append(x[max(math.ceil(n * share), 1) - 1] if kind == "nearest" else x[round(at)])
    return out


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_quantiles_are_those_of_the_sorted_values(spark, accuracy):
    r = random.Random(1)
    groups = {"hot": [r.choice([1.0, 2.0, 2.5, 1e9]) if r.random() < 0.5 else r.uniform(-5, 5) for _ in range(4000)], None: [r.uniform(0, 1) for _ in range(77)], "one": [3.5], "two": [1.0, 2.0], "equal": [7.0] * 50}
    rows = [(k, v) for k, x in groups.items() for v in x] + [("none", None), ("two", None)]
    r.shuffle(rows)
    got = {x.k: tuple(x)[1:] for x in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], F.col("v"), WANTED, accuracy).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert got[k] == pytest.approx(by_sorting(x), rel=1e-12), k


def test_no_keys_and_no_rows(spark):
    values = spark.range(101).select(F.col("id").alias("v"))
    assert [tuple(x) for x in quantiles(values, [], F.col("v"), {"p": ("nearest", 0.5), "q": ("continuous", 0.5)}).collect()] == [(50, 50.0)]
    assert quantiles(values.where("v < 0"), [], F.col("v"), {"p": ("nearest", 0.5)}).count() == 0


def test_groups_meet_their_marks_without_a_sort(spark):
    """Sketches are larger than what Spark broadcasts here, marks are smaller: no group is sorted in one task for a join."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        values = spark.range(60_000, numPartitions=4).selectExpr("id % 3 AS k", "CAST(id * 7919 % 100003 AS DOUBLE) AS v")
        found = quantiles(values, ["k"], F.col("v"), {"p": ("nearest", 0.5)})
        assert found.count() == 3
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(rows) == 3 and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
