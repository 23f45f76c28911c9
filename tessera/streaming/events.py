"""Structured Streaming over landed files: event-time windows, sessions, dedupe, and the snapshot merge as a sink."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lifecycle as L


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for checkpoints and results: in the shared folder the cluster names, or a temporary one on a single machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    top = top or tempfile.mkdtemp(prefix="spark-stream-")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed files as a stream; the event time is made a TIMESTAMP, as watermarks ask."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path + "*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each kind in each window (I16)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once, as long as its repeats are no later than the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that has landed, and read its result from the shared folder.

    What a batch appends has a folder of its own, which is written anew if the batch is run again.
    """
    spark = stream.sparkSession
    top = scratch(spark, name)

    def save(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{top}/out" if mode == "complete" else f"{top}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    result = spark.read.parquet(f"{top}/out")
    return result if mode == "complete" else result.drop("epoch")


def merge_sink(top: str, as_of: Callable[[int], str], expiry: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges each batch of snapshots into the next version of the records.

    Versions are folders named by the batch, so a batch that is run again writes the same version again.
    """

    def save(df: DataFrame, epoch: int) -> None:
        fetched = L.usable(df)
        spark = df.sparkSession
        current = spark.read.parquet(f"{top}/v{epoch}") if epoch else fetched.limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("first_seen", "timestamp_ntz"), ("last_seen", "timestamp_ntz"), ("expired_at", "timestamp_ntz"), ("seen_count", "int"))])
        L.merge(current, fetched, fetched, F.lit(as_of(epoch)).cast("timestamp_ntz"), expiry).write.mode("overwrite").parquet(f"{top}/v{epoch + 1}")

    return save
