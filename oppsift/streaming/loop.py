"""Cycles driven by arriving files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oppsift.operators.normalize import limited
from oppsift.plans.cycle import Cycle, Engine
from oppsift.sources.landing import LIMITS, feed_posts, posts


def stream_landed(spark: SparkSession, folder: str) -> DataFrame:
    """What lands in folder/<source>/*, as source, path, landed_at and value: lines of JSON, and feeds whole."""
    streams = []
    for names, whole in ((",".join(s for s in LIMITS if s != "rss"), False), ("rss", True)):
        found = spark.readStream.format("text").option("wholetext", whole).load(f"{folder}/{{{names}}}")
        path = F.col("_metadata.file_path")
        source = F.regexp_extract(path, "/(" + "|".join(LIMITS) + ")/[^/]*$", 1)
        streams.append(found.select(source.alias("source"), path.alias("path"), F.col("_metadata.file_modification_time").alias("landed_at"), "value"))
    return streams[0].unionByName(streams[1])


def bronze_of(batch: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The posts of a batch of ``stream_landed``, read and limited as ``read_landed`` does."""
    rows = batch.orderBy("path")
    parts = [(feed_posts if s == "rss" else lambda lines, s=s: posts(lines, s))(rows.where(F.col("source") == s)) for s in LIMITS]
    return limited(reduce(DataFrame.unionByName, parts), LIMITS | (limits or {}))


def start(engine: Engine, checkpoint: str, every: str | None = None, clock: Callable[[], datetime] = lambda: datetime.now(UTC), on_cycle_done: Callable[[Cycle], None] | None = None) -> StreamingQuery:
    """Runs a cycle for each micro-batch: every ``every`` ("30 minutes"), or once over all that has landed.

    The batch number is the run's id, so a batch that is tried again after a failure gives the same ids, and takes the place of
    what its first attempt stored. A cycle that another run keeps from publishing fails, and is tried again with the query.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        done = engine.run(clock(), f"batch-{number:09d}", bronze=bronze_of(batch))
        if on_cycle_done:
            on_cycle_done(done)

    writer = stream_landed(engine.spark, engine.landing).writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def engagement_rate(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events (ts, event_type, value) counted by window and type as they come, the last of ``late`` waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
