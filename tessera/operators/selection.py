"""Exact percentiles of groups of any size.

No group's values meet in one buffer or task.  A sketch of fixed size gives two
splitters near each wanted rank; exact counts of the values below and between them say
on which side of them the rank lies (between them, unless the sketch was off, which
costs time and not correctness); and of the values there, counted by value first, the
one at the rank is taken.  With an ``accuracy`` of a, about 4 / a of a group's rows are
left for that last step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inverse of the sketch's error of rank.
ACCURACY = 10_000


def _ranks(kind: str, share: float, n: Column) -> list[Column]:
    """The ranks, from 1, whose values a percentile is made of."""
    if kind == "nearest":
        return [F.greatest(F.ceil(n * F.lit(share)), F.lit(1))]
    at = F.lit(share) * (n - 1)
    if kind == "index":
        return [F.bround(at, 0).cast("long") + 1]
    return [F.floor(at) + 1, F.ceil(at) + 1]


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys), F.lit(True))


def quantiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, tuple[str, float]], accuracy: int = ACCURACY) -> DataFrame:
    """The keys, and a column for each ``wanted`` name, of every group with a value that isn't null.

    ``wanted`` names (kind, share): ``continuous`` interpolates between ranks, ``nearest`` is the value at rank
    ceil(n * share), ``index`` that at round(share * (n - 1)) counted from 0, half to even.  Null keys are a group.
    """
    vals = df.select(*keys, value.alias("v")).where(F.col("v").isNotNull())
    n = F.col("n")
    targets = [(name, part, rank, share) for name, (kind, share) in wanted.items() for part, rank in enumerate(_ranks(kind, share, n))]
    near = [min(1.0, max(0.0, share + side * 2 / accuracy)) for *_, share in targets for side in (-1, 1)]
    # Rows of a group meet its marks in a join on the keys, of which there may be few: an exchange of the marks themselves shows
    # Spark how small they are (the sketches that they are made of are not), so that it sends them and sorts no group in one task.
    small = (lambda x: x.hint("rebalance")) if keys else (lambda x: x)
    sketched = vals.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, near)), accuracy).alias("cuts"))
    sketched = small(sketched)
    cuts = [(F.col("cuts")[2 * i], F.col("cuts")[2 * i + 1]) for i in range(len(targets))]
    both = vals.alias("x").join(sketched.alias("s"), _same("x", "s", keys))
    marks = both.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], "n", "cuts").agg(*[c for i, (low, high) in enumerate(cuts) for c in (F.count_if(F.col("v") < low).alias(f"below{i}"), F.count_if(F.col("v") <= high).alias(f"upto{i}"))])
    part = lambda i, rank: F.when(rank <= F.col(f"below{i}"), 0).when(rank <= F.col(f"upto{i}"), 1).otherwise(2)
    left = lambda i, rank: rank - F.when(rank <= F.col(f"below{i}"), 0).when(rank <= F.col(f"upto{i}"), F.col(f"below{i}")).otherwise(F.col(f"upto{i}"))
    zones = marks.select(*keys, F.array(*[F.struct(F.lit(i).alias("target"), part(i, rank).alias("part"), left(i, rank).alias("left"), low.alias("low"), high.alias("high")) for i, ((_, _, rank, _), (low, high)) in enumerate(zip(targets, cuts))]).alias("zones"))
    zones = small(zones)
    inside = lambda z: F.when(z["part"] == 0, F.col("v") < z["low"]).when(z["part"] == 1, F.col("v").between(z["low"], z["high"])).otherwise(F.col("v") > z["high"])
    rest = vals.alias("x").join(zones.alias("s"), _same("x", "s", keys)).select(*[F.col(f"s.{k}").alias(k) for k in keys], "v", F.explode(F.filter("zones", inside)).alias("z"))
    counted = rest.groupBy(*keys, F.col("z.target").alias("target"), F.col("z.left").alias("left"), "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "target").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    chosen = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("c") < F.col("left")))
    at = chosen.groupBy(*keys).agg(*[F.max(F.when(F.col("target") == i, F.col("v"))).alias(f"at{i}") for i in range(len(targets))])
    number = {(name, part): i for i, (name, part, _, _) in enumerate(targets)}
    sizes = marks.select(*keys, "n")

    def told(name: str, kind: str, share: float) -> Column:
        low = F.col(f"at{number[name, 0]}")
        if kind != "continuous":
            return low
        place = F.lit(share) * (n - 1)
        return F.when(F.floor(place) == place, low.cast("double")).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * F.col(f"at{number[name, 1]}"))

    joined = at.alias("a").join(sizes.alias("s"), _same("a", "s", keys))
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], *[told(name, *how).alias(name) for name, how in wanted.items()])


def beside(main: DataFrame, keys: list[str], other: DataFrame) -> DataFrame:
    """``main`` with the other columns of ``other`` where it has the keys (null keys are equal)."""
    rest = [c for c in other.columns if c not in keys]
    return main.alias("m").join(other.alias("o"), _same("m", "o", keys), "left").select("m.*", *[F.col(f"o.{c}") for c in rest])
