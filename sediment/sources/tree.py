"""Repository trees as tables: a directory on a file system, and a Python data source over listings and fetchers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..functions import scalar as S

TREE = "path string, type string, size_bytes bigint, sha string"
MAX_FETCHES = 15


def local_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes, content of the analysed files below a directory; names and sizes prune before contents are read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace("path", f"^.*?{base.lstrip('/')}/", "")
    rows = files.select(rel.alias("path"), F.col("length").alias("size_bytes"), "content")
    return rows.where(S.included(F.col("path"), F.col("size_bytes"))).select("path", "size_bytes", F.decode("content", "UTF-8").alias("content"))


class TreeSource(DataSource):
    """``format("repo_tree")``: blobs of a directory listing; a filter on ``type`` is taken by the source."""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path") or options["root"]
        self.kind = options.get("type")

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type",):
                self.kind = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(d) for d in sorted(e.name if e.is_dir() else "" for e in os.scandir(self.root))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        top = partition.value
        for here, dirs, names in os.walk(os.path.join(self.root, top)):
            if not top:
                dirs.clear()
            rel = os.path.relpath(here, self.root)
            rows = [("tree", d, None) for d in dirs] + [("blob", n, os.path.getsize(os.path.join(here, n))) for n in names]
            for kind, n, size in rows:
                if not self.kind or kind == self.kind:
                    yield (n if rel == "." else f"{rel}/{n}", kind, size, None)


def register(spark: SparkSession) -> None:
    """Make ``repo_tree`` known, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def blobs(tree: DataFrame) -> DataFrame:
    return tree.where("type = 'blob'")


def fetched(paths: DataFrame, fetch: Callable[[str, str], str | None], repo: str = "repo", path: str = "path") -> DataFrame:
    """paths with ``content`` by a callable (repo, path) -> text or None, at most MAX_FETCHES at a time in each partition; what cannot be fetched is dropped."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(pair):
            try:
                return fetch(*pair)
            except OSError:
                return None

        with ThreadPoolExecutor(MAX_FETCHES) as pool:
            for pdf in it:
                text = list(pool.map(one, zip(pdf[repo], pdf[path])))
                yield pdf.assign(content=text)[[t is not None for t in text]]

    fields = ", ".join(f"`{n}` {k}" for n, k in paths.dtypes)
    return paths.mapInPandas(run, f"{fields}, content string")


def metadata(fetch: Callable[[str, str], tuple[int, dict]], owner: str, name: str) -> dict:
    """Metadata of a repository by a callable (owner, name) -> (status, fields)."""
    status, fields = fetch(owner, name)
    if status == 404:
        raise ValueError(f"no repository {owner}/{name}")
    if status in (401, 403):
        raise PermissionError(f"no access to {owner}/{name}")
    return fields
