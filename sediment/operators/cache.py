"""Explanations kept by content: lookup, misses, upsert, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def keyed(files: DataFrame) -> DataFrame:
    """files(owner, repo_name, path, sha) with cache_key; a file without sha has no key."""
    return files.withColumn("cache_key", F.when(F.coalesce("sha", F.lit("")) != "", S.cache_key(F.col("owner"), F.col("repo_name"), F.col("path"), F.col("sha"))))


def lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files with ``explanation``; an entry that is empty is a miss."""
    good = cache.where("explanation IS NOT NULL AND explanation <> ''").select("cache_key", "explanation")
    return keyed(files).join(good, "cache_key", "left")


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    good = cache.where("explanation IS NOT NULL AND explanation <> ''").select("cache_key")
    return keyed(files).join(good, "cache_key", "left_anti")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both, the latest cached_at of each key; entries without a key are not kept."""
    w = Window.partitionBy("cache_key").orderBy(F.desc("cached_at"), F.desc("is_new"))
    both = cache.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1))).where("cache_key IS NOT NULL")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "is_new")


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.round(F.coalesce(F.sum(F.octet_length("explanation")), F.lit(0)) / 1024, 1).alias("kilobytes"))
