"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are put into a hashed order and cut into blocks.  Time is
counted in slots of one block.  Block k (from 1) of a source with weight w may
not start before slot floor((k-1)/w) and must be done by slot ceil(k/w); of the
blocks released, the one with the earliest deadline takes the slot.  Then at any
time each source is less than one block away from its share.

Weights are rounded to multiples of 1/period, so the schedule repeats after
``period`` slots (4096, or more where there are more than a quarter as many
sources); one period is scheduled by one small task and every row finds its slot
by a join.  No task sees a source as a whole: rows are numbered within hashed
buckets, and the buckets' sizes are summed up in two levels for the offsets.

Every row is kept once, so a source that runs out leaves its slots empty, and the
others go on at their rates.

Defined results: rows without a source form a source of their own; rows with a
null id take part (and come where the hash of null puts them); weights that are
not positive or missing count as the smallest possible; columns keep their values
whatever their names (but for ``mix``, see there); no rows give no rows.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed, shuffle_parts

PERIOD = 4096
BLOCK_ROWS = 32
#: Target weights are proportional to a source's rows raised to this power, if none are given.
TEMPERATURE = 0.7
#: Rows of a bucket in which rows are numbered, on average.
BUCKET_ROWS = 500
#: Buckets in a group of them.
GROUP = 1000
#: A schedule of at most so many blocks is sent to all tasks; a longer one is joined.
BROADCAST_BLOCKS = 65_536


def units(weights: list[float], period: int) -> list[int]:
    """Weights as whole shares of ``period``: at least 1 each, by largest remainders."""
    n, total = len(weights), sum(weights)
    free = period - n
    exact = [w / total * free if total > 0 else free / n for w in weights]
    out = [1 + int(x) for x in exact]
    for i in sorted(range(n), key=lambda i: (int(exact[i]) - exact[i], i))[: period - sum(out)]:
        out[i] += 1
    return out


def schedule(shares: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(source, block from 0, release, deadline, slot) of one period, whose length is the sum of the shares."""
    period = sum(shares)
    window = lambda s, k: (k * period // shares[s], -(-(k + 1) * period // shares[s]))
    waiting = [(0, s, 0) for s in range(len(shares))]  # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, k)[1], s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, release, deadline, slot))
        if k + 1 < shares[s]:
            heapq.heappush(waiting, (window(s, k + 1)[0], s, k + 1))
    return out


def period_table(weights: DataFrame) -> DataFrame:
    """The schedule of one period for (key, weight): key, share, period, k, release, deadline, slot."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        period = PERIOD
        while period < 4 * len(pdf):
            period *= 2
        shares = units([w if w == w and w > 0 else 0.0 for w in pdf["weight"]], period)
        rows = [(pdf["key"][s], shares[s], period, k, r, d, slot) for s, k, r, d, slot in schedule(shares)]
        return pd.DataFrame(rows, columns=["key", "share", "period", "k", "release", "deadline", "slot"])

    return weights.select("key", "weight", F.lit(1).alias("one")).groupBy("one").applyInPandas(run, "key string, share long, period long, k long, release long, deadline long, slot long")


def source_key(source: Column) -> Column:
    """A key without nulls."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def offsets_of(sizes: DataFrame) -> DataFrame:
    """key, bucket and offset (the rows of the key in the buckets before) of (key, bucket, n), summed up in two levels:
    within groups of ``GROUP`` buckets, and over the groups of a key."""
    grouped = sizes.withColumn("span", F.floor(F.col("bucket") / GROUP))
    spans = grouped.groupBy("key", "span").agg(F.sum("n").alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    begins = spans.select("key", "span", F.coalesce(F.sum("n").over(before("key", "span")), F.lit(0)).alias("begin"))
    inner = grouped.withColumn("inner", F.coalesce(F.sum("n").over(before("key", "span", "bucket")), F.lit(0)))
    return inner.join(begins, ["key", "span"]).select("key", "bucket", (F.col("begin") + F.col("inner")).alias("offset"))


def mixed_rows(df: DataFrame, weights: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """row (all columns of ``df`` as a struct) and mix, as told for ``mix``."""
    ident = F.col(f"`{id_col}`")
    key, order = source_key(F.col(f"`{source_col}`")), F.xxhash64(ident, F.lit(17))
    total = df.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    bucket = F.pmod(order, F.lit(buckets))
    sizes = df.groupBy(key.alias("key"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    if weights is None:
        wanted = sizes.groupBy("key").agg(F.pow(F.sum("n").cast("double"), TEMPERATURE).alias("weight"))
    else:
        given = weights.select(source_key(F.col("source")).alias("key"), F.col("weight").cast("double").alias("weight")).groupBy("key").agg(F.max("weight").alias("weight"))
        wanted = sizes.select("key").distinct().join(given, "key", "left")
    table = period_table(wanted)
    shares = table.where("k = 0").select("key", "share")
    blocks = table.select(F.col("key").alias("p_key"), F.col("k").alias("p_k"), "period", "release", "deadline", "slot")
    n_sources = sizes.select("key").distinct().count()
    if max(PERIOD, 8 * n_sources) <= BROADCAST_BLOCKS:
        blocks, shares = F.broadcast(blocks), F.broadcast(shares)
    within = Window.partitionBy("key", "bucket").orderBy("order", "id")
    rows = packed(df, key=key, bucket=bucket, order=order, id=ident).withColumn("nth", F.row_number().over(within) - 1)
    rows = rows.join(offsets_of(sizes), ["key", "bucket"]).withColumn("at", F.col("offset") + F.col("nth")).withColumn("block", F.floor(F.col("at") / block_rows))
    rows = rows.join(shares, "key").withColumns({"turn": F.floor(F.col("block") / F.col("share")), "own": F.col("block") % F.col("share")})
    rows = rows.join(blocks, (F.col("key") == F.col("p_key")) & (F.col("own") == F.col("p_k")))
    shift = F.col("turn") * F.col("period")
    slot = (shift + F.col("slot")).cast("long")
    mixed = F.struct(
        F.col("block").cast("long").alias("block"), (shift + F.col("release")).cast("long").alias("release"), (shift + F.col("deadline")).cast("long").alias("deadline"),
        slot.alias("slot"), (slot * block_rows + F.col("at") % block_rows).cast("long").alias("position"), "share", "period",
    )
    return rows.select("row", mixed.alias("mix"))


def mix(df: DataFrame, weights: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with the column ``mix`` added (in place of any of that name): block, release, deadline and slot of the row's block, and the row's position.

    ``weights`` has the columns source and weight; without it, see ``TEMPERATURE``.
    """
    others = [F.col(f"row.`{c}`") for c in df.columns if c != "mix"]
    return mixed_rows(df, weights, source_col, id_col, block_rows).select(*others, "mix")


def laid_out(df: DataFrame, weights: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df``, unchanged, partition after partition in the order of the mix."""
    mixed = mixed_rows(df, weights, source_col, id_col)
    return mixed.repartitionByRange(shuffle_parts(df.sparkSession), "mix.position").sortWithinPartitions("mix.position").select("row.*")
