"""Grouped measures of the reports: filtered counts, ratios, percentiles, top values, set hashes, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, digits: int = 2) -> Column:
    """Share of a group's rows in percent, 0 for an empty group."""
    return F.round(100.0 * F.count_if(part) / F.greatest(F.count("*"), F.lit(1)), digits).cast("double")


def percent_or_null(part: Column, digits: int = 2) -> Column:
    """Share in percent, null for an empty group."""
    return F.round(100.0 * F.count_if(part) / F.nullif(F.count("*"), F.lit(0)), digits).cast("double")


def latest(*columns: str) -> Column:
    """The latest of several timestamps in a group; nulls are passed over."""
    return F.max(F.greatest(*columns))


def top_values(df: DataFrame, keys: list[str], value: str, position: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each group as a list, ties in order of first occurrence."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("at"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "at")
    ranked = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda x: x["v"]).alias("top_values"))


def set_hash(*parts: Column) -> Column:
    """A hash of a group's rows that doesn't depend on their order."""
    return F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("|", *parts)))), 256)


def years_between(start: Column, end: Column, as_of: Column) -> Column:
    """Summed lengths of spans in years, open ones up to ``as_of``; spans of no length don't count."""
    days = F.datediff(F.coalesce(end, as_of), start)
    return F.bround(F.sum(F.when(days > 0, days).otherwise(0)) / 365.25, 2)


def last_wins(df: DataFrame, keys: list[str], name: str, value: str, order: list[Column]) -> DataFrame:
    """Key/value rows as one map for each group; of equal names the last counts."""
    w = Window.partitionBy(*keys, name).orderBy(*order)
    last = df.withColumn("r", F.row_number().over(w)).where("r = 1")
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("facts"))


def rolling(value: Column, keys: list[str], order: str, rows: int) -> Column:
    """Sum over the last ``rows`` rows."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0))
