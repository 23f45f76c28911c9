"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query deletes its shuffle files as it ends.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes in one Arrow batch handed to Python, for all operators alike: texts may be long, so bytes bound a batch.
ARROW_ROWS, ARROW_BYTES = 4096, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; any path Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; all operators ask for the same bounds, so none changes what another relies on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only on a single machine where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``df`` as one struct column ``row`` beside ``columns`` made from them, so that no name of the caller's can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries made in this block delete their shuffle files as they end.

    Otherwise files stay until the driver happens to collect its garbage, and an operator of many
    rounds holds those of all rounds at once.  The session's own setting comes back after the block.
    """
    before = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREES) if before is None else spark.conf.set(FREES, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder, and drop its lineage and its shuffle files."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query of its own: the setting counts when a query is made


def first_row(df: DataFrame) -> Row:
    """The first row of ``df``, whose shuffle files are deleted then."""
    with shuffles_freed(df.sparkSession):
        return df.select("*").first()


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A column of texts as Python strings; null becomes the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """Columns (lists, in the schema's order) as one record batch."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

