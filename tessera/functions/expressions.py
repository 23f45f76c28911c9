"""Small building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row: a filter on them isn't pushed below and doesn't repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def small_batches(spark: SparkSession, rows: int = 4096, size: int = 2 << 20) -> None:
    """Bound what is handed to a Python worker at once by bytes too: pages may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
