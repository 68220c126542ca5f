"""Streams of events: reading with back-pressure, routing, daily usage, single delivery, sessions, and the catalogue as a sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postlake.operators import catalog, states


def read_events(spark: SparkSession, folder: str, schema: str | StructType, files_per_batch: int = 1) -> DataFrame:
    """Events of a folder of Parquet files; a micro-batch takes so many files at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream holds now, in micro-batches appended to a new table in ``folder``; a run that's lost goes on from its checkpoint."""
    path = f"{folder}/drained-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def audience(events: DataFrame, followed: DataFrame, workspace: object) -> DataFrame:
    """The events that a workspace's clients get."""
    return states.routed(events, followed, workspace)


def daily_usage(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, day, n): events per UTC day; a day is closed once events are ``late`` beyond its end."""
    per = events.withWatermark(ts, late).groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n"))
    return per.select(key, F.col("w.start").alias("day"), "n")


def delivered_once(events: DataFrame, key: str, ts: str = "ts", life: str = "24 hours") -> DataFrame:
    """Events whose key wasn't seen within ``life`` of event time."""
    return events.withWatermark(ts, life).dropDuplicatesWithinWatermark([key])


def in_flight(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 seconds") -> DataFrame:
    """(key, started_at, n): runs of a key's events without a gap."""
    per = events.withWatermark(ts, gap).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return per.select(key, F.col("w.start").alias("started_at"), "n")


def catalogue_sink(spark: SparkSession, folder: str, empty: DataFrame, now: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that applies listings to the catalogue in ``folder``.

    Every version of the catalogue is written under its batch's number, so a batch that comes again
    starts from the version before it and gives the same one.
    """

    def version(n: int) -> DataFrame:
        while n >= 0:
            try:
                return spark.read.parquet(f"{folder}/{n}")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                n -= 1
        return empty

    def apply(listing: DataFrame, batch: int) -> None:
        catalog.apply_listing(version(batch - 1), listing, now()).drop("change").write.mode("overwrite").parquet(f"{folder}/{batch}")

    return apply
