"""Job and file events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "job_id string, repo string, ts timestamp, received_at timestamp, kind string, phase string, progress int, error string"


def read(spark: SparkSession, place: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(place)


def phase_windows(events: DataFrame, lateness: str = "2 days", width: str = "1 hour") -> DataFrame:
    """Events of each kind and phase per window of event time, once each; what comes later than ``lateness`` is left out."""
    once = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["job_id", "ts", "kind", "phase", "progress"])
    return once.groupBy(F.window("ts", width), "kind", "phase").agg(F.count("*").alias("n_events")).select("window.start", "kind", "phase", "n_events")


def job_state(events: DataFrame) -> DataFrame:
    """Status of each job as of its events so far; for update or complete output."""
    g = events.groupBy("job_id").agg(F.max(F.coalesce("progress", F.lit(0))).alias("progress"), F.max((F.col("kind") == "error").cast("int")).alias("failed"), F.max((F.col("kind") == "phase").cast("int")).alias("started"), F.max("ts").alias("updated_at"))
    status = F.when(F.col("failed") == 1, "failed").when(F.col("progress") >= 100, "complete").when(F.col("started") == 1, "running").otherwise("queued")
    return g.select("job_id", status.alias("status"), "progress", "updated_at")


def new_files(files: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Files whose content was not seen before, by sha."""
    return files.where("sha IS NOT NULL").withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["sha"])
