"""Event streams: daily rollups with a watermark, tumbling counters, and a batch sink that replaces days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily(events: DataFrame, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Counts and value sums by day and type; events later than ``late`` are left out."""
    marked = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return marked.groupBy(F.window(ts, "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("value")).select(F.to_date("w.start").alias("day"), "event_type", "n", "value")


def tumbling(events: DataFrame, key: str, seconds: int, limit: int, ts: str = "ts") -> DataFrame:
    """Events by key and window of the epoch, and how many of them are over the limit."""
    marked = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{seconds} seconds")
    counted = marked.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_seconds("w.start").alias("start"), key, "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def replacing_days(path: str):
    """A foreachBatch sink that overwrites the days of its batch and leaves the others."""

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return sink


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """All that is there now, into a table of days."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(replacing_days(path)).start().awaitTermination()


def recomputing_days(spark: SparkSession, source: str, path: str, days: int = 2):
    """A foreachBatch sink: the last ``days`` days up to the latest event of a batch are computed again from all events.

    Events that are late by less than that are counted wherever they come; older days need a run of their own.
    """
    sink = replacing_days(path)

    def refresh(batch: DataFrame, n: int) -> None:
        last = batch.agg(F.max(F.to_date("ts"))).first()[0]
        if last is not None:
            sink(daily(spark.read.parquet(source).where(F.to_date("ts") > F.date_sub(F.lit(last), days))), n)

    return refresh
