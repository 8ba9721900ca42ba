"""What the operators share: table access, languages by path, Arrow batches, scratch places."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code languages by file extension.
CODE_EXTENSIONS = {"py": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "go": "Go", "java": "Java", "rs": "Rust", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++"}
CODE_LANGUAGES = tuple(dict.fromkeys(CODE_EXTENSIONS.values()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_of(path: Column) -> Column:
    """The code language that a path's extension declares; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in CODE_EXTENSIONS.items() for x in kv])[ext]


def code_files(contents: DataFrame, *extra: str) -> DataFrame:
    """Rows of ``contents`` that are code files with content: file_id, extra columns, language, content, and whether the path allows JSX."""
    df = contents.select("file_id", *extra, language_of(F.col("path")).alias("language"), "content", F.col("path").rlike(r"(?i)\.[jt]sx$").alias("jsx"))
    return df.where("file_id IS NOT NULL AND content IS NOT NULL AND language IS NOT NULL")


def confirmed(found: DataFrame, files: DataFrame) -> DataFrame:
    """Keep rows whose language is the one in ``files``; the found rows are few, so this moves no content."""
    return found.join(files.select("file_id", "language").distinct(), ["file_id", "language"], "left_semi")


def over(df: DataFrame, fn: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str, names: list[str], types: list[pa.DataType], rows: int = 2000) -> DataFrame:
    """Run ``fn`` (rows in, rows out) over each partition in Arrow batches of bounded length."""
    arrow = pa.schema(list(zip(names, types)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source():
            for b in it:
                for start in range(0, b.num_rows, 256):
                    part = b.slice(start, 256)
                    yield from zip(*[c.to_pylist() for c in part.columns])

        out: list[tuple] = []
        for row in fn(source()):
            out.append(row)
            if len(out) >= rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=arrow)

    return df.mapInArrow(batches, schema)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the session names for checkpoints; a local one only in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/sediment-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the scratch folder: computed once, and again only if that folder is lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
