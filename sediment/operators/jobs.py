"""Jobs as an append-only log of events, and their latest state.

Events arrive late and twice; the order of a job is (ts, received_at, kind, progress), repeats are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PHASES

KEYS = ["job_id", "repo", "ts", "received_at", "kind", "phase", "progress", "error"]


def events(log: DataFrame) -> DataFrame:
    return log.where("job_id IS NOT NULL").select(*KEYS).distinct()


def status(failed: Column, progress: Column, started: Column) -> Column:
    return F.when(failed, "failed").when(progress >= 100, "complete").when(started, "running").otherwise("queued")


def latest(log: DataFrame) -> DataFrame:
    """job_id, repo, status, current_phase, progress, created_at, updated_at, error of each job."""
    last_phase = F.max_by(F.when(F.col("kind") == "phase", F.col("phase")), F.when(F.col("kind") == "phase", F.struct("ts", "received_at", "progress")))
    g = events(log).groupBy("job_id").agg(
        F.max("repo").alias("repo"),
        F.bool_or(F.col("kind") == "error").alias("failed"),
        F.coalesce(F.max("progress"), F.lit(0)).alias("progress"),
        F.bool_or(F.col("kind") == "phase").alias("started"),
        last_phase.alias("current_phase"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("kind") == "error", F.nullif("error", F.lit("")))).alias("error"),
    )
    return g.select("job_id", "repo", status(F.col("failed"), F.col("progress"), F.col("started")).alias("status"), "current_phase", "progress", "created_at", "updated_at", F.when(F.col("failed"), F.coalesce("error", F.lit("unknown error"))).alias("error"))


def phases(log: DataFrame) -> DataFrame:
    """job_id, phases: those seen, in the order of their first events, without repeats."""
    first = events(log).where("kind = 'phase' AND phase IS NOT NULL").groupBy("job_id", "phase").agg(F.min("ts").alias("ts"), F.min("progress").alias("p"))
    return first.groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "p", "phase"))), lambda x: x["phase"]).alias("phases"))


def phase_status(log: DataFrame) -> DataFrame:
    """job_id, phase, state for all phases of each job: queued, running, complete or failed."""
    jobs = latest(log).select("job_id", "status", "current_phase")
    dim = F.posexplode(F.array(*map(F.lit, PHASES)))
    at = F.array_position(F.array(*map(F.lit, PHASES)), F.coalesce("current_phase", F.lit(""))) - 1
    rows = jobs.withColumn("at", at).select("job_id", "status", "at", dim.alias("i", "phase"))
    state = F.when(F.col("status") == "complete", "complete").when(F.col("i") < F.col("at"), "complete").when(F.col("i") == F.col("at"), F.when(F.col("status") == "failed", "failed").otherwise("running")).otherwise("queued")
    return rows.select("job_id", "phase", state.alias("state"))


def progress_bar(log: DataFrame) -> DataFrame:
    """Share of phases done, half for one that runs."""
    s = phase_status(log)
    return s.groupBy("job_id").agg(F.round((F.count_if(F.col("state") == "complete") + 0.5 * F.count_if(F.col("state") == "running")) / len(PHASES) * 100).cast("int").alias("percent"))


def active(log: DataFrame) -> DataFrame:
    return latest(log).where("status IN ('queued', 'running')")


def active_per_repo(log: DataFrame) -> DataFrame:
    """Repositories with an active job, which a new one would duplicate."""
    return active(log).where("repo IS NOT NULL").groupBy("repo").agg(F.count("*").alias("n_active"))


def listed(log: DataFrame) -> DataFrame:
    """Jobs of each repository, the newest first."""
    w = Window.partitionBy("repo").orderBy(F.desc("created_at"), "job_id")
    return latest(log).select("repo", F.row_number().over(w).alias("position"), "job_id", "status", "created_at")


def phase_seconds(log: DataFrame) -> DataFrame:
    """Mean seconds from the start of each phase to the next event of the job."""
    w = Window.partitionBy("job_id").orderBy("ts", "received_at", "kind", "progress")
    e = events(log).withColumn("next_ts", F.lead("ts").over(w)).where("kind = 'phase' AND next_ts IS NOT NULL")
    return e.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.avg((F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6), 3).alias("mean_seconds"))
