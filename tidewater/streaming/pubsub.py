"""Publish and subscribe, and event-time windows, over Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewater.sources.files import delete_at_exit, shared_folder


@dataclass
class Stream:
    name: str
    schema: StructType
    path: str
    callbacks: list[Callable[[str, DataFrame], None]] = field(default_factory=list)


class Hub:
    """Named streams, each a folder of Parquet batches. Publishing appends a batch and calls the subscribers with it before it returns;
    the same folder can be followed as a stream by any number of queries, here or elsewhere."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.streams: dict[str, Stream] = {}

    def define(self, name: str, empty: DataFrame) -> None:
        """Start a stream with the columns of an empty table."""
        path = f"{self.folder}/{name}"
        empty.limit(0).write.mode("overwrite").parquet(path)
        self.streams[name] = Stream(name, empty.schema, path)

    def _stream(self, name: str) -> Stream:
        if name not in self.streams:
            raise KeyError(f"no stream {name}")
        return self.streams[name]

    def subscribe(self, name: str, callback: Callable[[str, DataFrame], None]) -> None:
        self._stream(name).callbacks.append(callback)

    def publish(self, name: str, rows: DataFrame) -> None:
        s = self._stream(name)
        if rows.columns != s.schema.names:
            raise ValueError(f"columns differ: {s.schema.names} and {rows.columns}")
        rows.select(*(F.col(f.name).cast(f.dataType) for f in s.schema.fields)).write.mode("append").parquet(s.path)
        for f in s.callbacks:
            f(name, rows)

    def get(self, name: str) -> DataFrame:
        """All that was published so far."""
        s = self._stream(name)
        return self.spark.read.schema(s.schema).parquet(s.path)

    def end(self, name: str, keep: str) -> DataFrame:
        """A snapshot at the end of the day; the stream goes on."""
        self.get(name).write.mode("overwrite").parquet(keep)
        return self.spark.read.parquet(keep)

    def follow(self, name: str) -> DataFrame:
        """The stream as a streaming DataFrame."""
        s = self._stream(name)
        return self.spark.readStream.schema(s.schema).parquet(s.path)


def follow_file(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    some = spark.read.option("pathGlobFilter", glob).parquet(folder)
    return spark.readStream.schema(some.schema).option("pathGlobFilter", glob).parquet(folder)


def tumbling(df: DataFrame, time: str, width: str, by: list[str], aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates by window of event time: (start, keys, aggregates). ``late``: how long a window waits for late rows."""
    at = df.withColumn("_t", F.col(time).cast("timestamp"))
    at = at.withWatermark("_t", late) if late else at
    made = at.groupBy(F.window("_t", width).alias("_w"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return made.select(F.col("_w.start").cast("timestamp_ntz").alias("start"), *by, *aggregates)


def sliding(df: DataFrame, time: str, width: str, step: str, by: list[str], aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    at = df.withColumn("_t", F.col(time).cast("timestamp"))
    at = at.withWatermark("_t", late) if late else at
    made = at.groupBy(F.window("_t", width, step).alias("_w"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return made.select(F.col("_w.start").cast("timestamp_ntz").alias("start"), *by, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, by: list[str], aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates by session: rows of a key with less than the gap between them."""
    at = df.withColumn("_t", F.col(time).cast("timestamp"))
    at = at.withWatermark("_t", late) if late else at
    made = at.groupBy(F.session_window("_t", gap).alias("_w"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return made.select(F.col("_w.start").cast("timestamp_ntz").alias("start"), *by, *aggregates)


def drain(df: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over all that is there now and give the result table. Results are written by the executors into the shared folder, a
    part for each micro-batch that a repeated batch replaces; in complete mode the last part is the result, else all are."""
    spark = df.sparkSession
    out = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    delete_at_exit(spark, out)
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/{number}")
        done.append(number)

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint or f"{out}/log").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    if not done:
        return spark.createDataFrame([], df.schema)
    wanted = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(df.schema).parquet(*(f"{out}/rows/{n}" for n in wanted))


def each_batch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call f with every micro-batch; what is done is remembered in the checkpoint folder, so that a restart goes on from there."""
    return df.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
