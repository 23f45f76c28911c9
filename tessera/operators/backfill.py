"""A pass over a table that can be stopped at any time and goes on where it was.

The table is cut into ranges of its key once, and the plan is written down.  A range's
result goes to a folder of its own and is committed by a row in the table of done
ranges, written after it.  A pass that begins again takes the ranges that aren't
done; one that was under way is written anew, so no row is there twice or missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN_DDL, DONE_DDL = "range int, low double, high double", "range int, rows bigint"


def _table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table at ``path``, empty if there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    return spark.read.schema(ddl).parquet(path) if held else spark.createDataFrame([], ddl)


def planned(df: DataFrame, key: str, top: str, ranges: int) -> list[tuple[int, float | None, float | None]]:
    """The ranges (number, from, to before) of the pass in the folder ``top``; made and written if there are none yet.

    They cover all keys: the first has no lower and the last no upper limit, and range -1 holds null keys.
    """
    spark = df.sparkSession
    found = _table(spark, f"{top}/plan", PLAN_DDL).collect()
    if not found:
        cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), [i / ranges for i in range(1, ranges)], 10_000).alias("cuts")).first().cuts if ranges > 1 else None
        cuts = sorted(set(cuts or []))
        rows = [(-1, None, None), *((i, low, high) for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])))]
        spark.createDataFrame(rows, PLAN_DDL).coalesce(1).write.mode("overwrite").parquet(f"{top}/plan")
        return rows
    return sorted(map(tuple, found))


def done(spark: SparkSession, top: str) -> DataFrame:
    """The committed ranges, with the rows that each has."""
    return _table(spark, f"{top}/done", DONE_DDL)


def advance(df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], top: str, ranges: int = 16, most: int | None = None) -> int:
    """Do ``work`` on the next ``most`` ranges (all, if None) that aren't done; returns how many are left after it.

    ``df`` has a number as its key.  If ``work`` fails, what was committed before it stays.
    """
    spark = df.sparkSession
    held = {r.range for r in done(spark, top).collect()}
    pending = [r for r in planned(df, key, top, ranges) if r[0] not in held]
    for n, low, high in pending[:most]:
        k = F.col(key).cast("double")
        inside = k.isNull() if n < 0 else k.isNotNull() & (k >= low if low is not None else F.lit(True)) & (k < high if high is not None else F.lit(True))
        part = f"{top}/out/range={n}"
        work(df.where(inside)).write.mode("overwrite").parquet(part)
        rows = spark.read.parquet(part).count()
        spark.createDataFrame([(n, rows)], DONE_DDL).coalesce(1).write.mode("append").parquet(f"{top}/done")
    return max(0, len(pending) - len(pending[:most]))


def result(spark: SparkSession, top: str) -> DataFrame:
    """The rows of the committed ranges; what a broken range left behind isn't among them."""
    held = [f"{top}/out/range={r.range}" for r in done(spark, top).select("range").distinct().collect()]
    return spark.read.parquet(*held)
