"""Name -> query function, and name -> the same query as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under ``name``, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "q_description_quality",
    """
    SELECT source, count(*) AS n,
           CAST(round(100.0 * count(*) FILTER (WHERE length(text) < 200) / greatest(count(*), 1), 2) AS DOUBLE) AS short_pct
    FROM documents GROUP BY source
    """,
)
def description_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = F.count_if(F.length("text") < 200)
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.round(100.0 * short / F.greatest(F.count("*"), F.lit(1)), 2).cast("double").alias("short_pct"))
