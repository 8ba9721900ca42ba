"""Files of a repository: what is analysed, in which language, how many, under which tier.

All operators take tables of many repositories and drop rows that were delivered twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import NOT_CODE, Limits
from ..functions import scalar as S


def manifest(files: DataFrame) -> DataFrame:
    """file_id, repo, path, language, size_bytes, sha of the files that are analysed; null paths are none."""
    kept = files.where(S.included(F.col("path"), F.col("size_bytes")))
    return kept.select("file_id", "repo", "path", S.language(F.col("path")).alias("language"), "size_bytes", "sha").dropDuplicates(["file_id"])


def with_lines(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Manifest with line counts; 0 where no content was fetched."""
    lines = contents.select("file_id", S.line_count(F.col("content")).alias("n_lines")).groupBy("file_id").agg(F.max("n_lines").alias("n_lines"))
    return manifest(files).join(lines, "file_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def language_breakdown(files: DataFrame, code_only: bool = False) -> DataFrame:
    rows = manifest(files)
    if code_only:
        rows = rows.where(~F.col("language").isin(*NOT_CODE))
    return rows.groupBy("repo", "language").agg(F.count("*").alias("n_files"))


def tier(n: Column, limits: Limits) -> Column:
    return F.when(n <= limits.full, "Full").when(n <= limits.warning, "Full (Warning)").otherwise("Sampled")


def analysis_tiers(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Files found and analysed, tier and admission of each repository; the cap applies after the count."""
    limits = limits or Limits()
    n = F.col("files_discovered")
    return manifest(files).groupBy("repo").agg(F.count("*").alias("files_discovered")).select("repo", n, F.least(n, F.lit(limits.sampled)).alias("files_analyzed"), tier(n, limits).alias("tier"), (n <= limits.sampled).alias("admitted"))


def capped(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The first files of each repository in the order of depth and path."""
    w = Window.partitionBy("repo").orderBy(S.path_depth(F.col("path")), "path")
    return manifest(files).withColumn("position", F.row_number().over(w)).where(F.col("position") <= (limits or Limits()).sampled)


def primary_language(files: DataFrame) -> DataFrame:
    """Most frequent language of each repository and its percentage; ties go to the first name."""
    counts = language_breakdown(files)
    w = Window.partitionBy("repo")
    ranked = counts.withColumn("total", F.sum("n_files").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n_files"), "language")))
    return ranked.where("rank = 1").select("repo", "language", F.round(100 * F.col("n_files") / F.col("total"), 1).alias("percent"))
