"""Requests without a web server: validation, admission, submission, status."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Limits
from ..operators import jobs as J
from ..operators import manifest as M
from ..sinks import drop_store

#: Hosts of the code hosting service whose repositories are analysed unless others are named.
HOSTS = ("github.com",)


class Rejected(ValueError):
    """A request that is not accepted, with the status a web service would give."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


@dataclass
class Request:
    repo_url: str
    max_explanations: int = 20
    options: dict = field(default_factory=dict)

    def validate(self, hosts: tuple[str, ...]) -> tuple[str, str]:
        """Owner and name; 422 for what is malformed or lies on another host."""
        if not 0 <= self.max_explanations <= 100:
            raise Rejected(422, "max_explanations must be between 0 and 100")
        bare = re.sub(r"^https?://", "", self.repo_url.strip().rstrip("/")).removesuffix(".git").split("/")
        host = bare[0].rpartition("@")[2].partition(":")[0].lower()
        if len(bare) < 3 or not (bare[1] and bare[2]) or host.removeprefix("www.") not in hosts:
            raise Rejected(422, "not a repository URL of " + " or ".join(hosts))
        return bare[1], bare[2]


class Service:
    """Jobs over an append-only table of events; repositories of ``hosts`` are accepted, and ``chunk_store`` holds their chunks."""

    def __init__(self, spark: SparkSession, log: DataFrame, files: DataFrame, limits: Limits | None = None, hosts: tuple[str, ...] = HOSTS, chunk_store: str | None = None):
        self.spark, self.log, self.files, self.limits, self.hosts, self.chunk_store = spark, log, files, limits or Limits(), hosts, chunk_store

    def admit(self, request: Request) -> str:
        """The repository's name; 409 if it has an active job, 400 if it is too large or unknown."""
        repo = "/".join(request.validate(self.hosts))
        if not J.active_per_repo(self.log).where(F.col("repo") == repo).isEmpty():
            raise Rejected(409, "a job for this repository is active")
        row = M.analysis_tiers(self.files.where(F.col("repo") == repo), self.limits).first()
        if row is None or not row["admitted"]:
            raise Rejected(400, "no such repository" if row is None else f"{row['files_discovered']} files are too many")
        return repo

    def submit(self, request: Request, job_id: str, now) -> DataFrame:
        """The event that queues a job, to be appended to the log."""
        return self.spark.createDataFrame([(job_id, self.admit(request), now, now, "status", None, 0, None)], "job_id string, repo string, ts timestamp_ntz, received_at timestamp_ntz, kind string, phase string, progress int, error string")

    def status(self, job_id: str) -> dict:
        row = J.latest(self.log.where(F.col("job_id") == job_id)).first()
        if row is None:
            raise Rejected(404, "no such job")
        return row.asDict()

    def result(self, job_id: str, results: DataFrame) -> dict:
        """The stored result; 409 while the job runs, 500 if it failed."""
        s = self.status(job_id)
        if s["status"] == "failed":
            raise Rejected(500, s["error"])
        if s["status"] != "complete":
            raise Rejected(409, "the job is not complete")
        row = results.where(F.col("job_id") == job_id).first()
        if row is None:
            raise Rejected(404, "no result")
        return row.asDict(recursive=True)

    def without(self, job_id: str) -> DataFrame:
        """The log without a job; the job's chunk store goes too."""
        self.status(job_id)
        if self.chunk_store:
            drop_store(self.spark, f"{self.chunk_store}/{job_id}")
        return self.log.where(F.col("job_id") != job_id)

    def listed(self) -> DataFrame:
        """All jobs of each repository, the newest first."""
        return J.listed(self.log)

    def health(self) -> dict:
        return {"status": "ok", "active": J.active(self.log).count()}
