"""Incremental ingest and idle sessions with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.sources.store import ChunkStore


def ingest_stream(stream: DataFrame, store: ChunkStore, checkpoint: str) -> StreamingQuery:
    """Add the chunks of a file stream to a store. Each batch adds only ids that the store lacks, so a batch that is repeated after a failure adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        store.add(batch)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def idle_sessions(events: DataFrame, user: str, time: str, gap: str = "600 seconds", delay: str | None = None) -> DataFrame:
    """(user, begin, stop, n): runs of events of a user at most ``gap`` apart; stop is the last event plus the gap.

    Works on a stream (give ``delay``, the watermark) and on a table alike. Null users and times take no part.
    """
    e = events.where(F.col(user).isNotNull() & F.col(time).isNotNull())
    if delay:
        e = e.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    got = e.groupBy(F.session_window(time, gap).alias("s"), F.col(user).alias("user")).agg(F.count("*").alias("n"))
    return got.select("user", F.col("s.start").alias("begin"), F.col("s.end").alias("stop"), "n")


def islands(events: DataFrame, user: str, time: str, gap_seconds: int = 600) -> DataFrame:
    """The same by gaps and islands, for tables."""
    w = W.partitionBy("user").orderBy("t")
    e = events.select(F.col(user).alias("user"), F.col(time).alias("t")).where("user is not null and t is not null")
    e = e.withColumn("new", (F.unix_micros("t") - F.unix_micros(F.lag("t").over(w)) > gap_seconds * 1_000_000).cast("int"))
    e = e.withColumn("k", F.sum(F.coalesce("new", F.lit(1))).over(w))
    return e.groupBy("user", "k").agg(F.min("t").alias("begin"), (F.max("t") + F.expr(f"interval {gap_seconds} seconds")).alias("stop"), F.count("*").alias("n")).drop("k")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the files of the Parquet table ``name`` below a folder, be it one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
