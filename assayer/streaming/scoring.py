"""An extension beyond the batch operators: decisions over a stream of events, by the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import policy
from assayer.sources import scratch

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event files. `path` may name a file or a folder."""
    return spark.readStream.schema(EVENTS).parquet(path[:-1] + f"[{path[-1]}]")


def decided(stream: DataFrame, threshold: float, band: float) -> DataFrame:
    return stream.withColumn("decision", policy.decision(F.col("value"), F.lit(threshold), F.lit(band)))


def hourly(decisions: DataFrame, late: str = "1 hour") -> DataFrame:
    """Decisions by hour and type; an hour is final once the watermark has passed it."""
    windowed = decisions.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type", "decision")
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "decision", "n")


def drained(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files that are there, through a checkpointed query that ends when they are read."""
    spark = stream.sparkSession
    out = scratch.folder(spark, tag)
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.folder(spark, f"{tag}-state")).format("parquet").trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
