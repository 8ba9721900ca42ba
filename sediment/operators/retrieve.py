"""Embedding and exact vector search under metadata filters."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 384
BLOCK = 2000
_TOKEN = re.compile(r"[A-Za-z]+|\d+")


def hashing_embedding(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector of signed token hashes; zero for blank texts.  Deterministic, needs no model."""
    v = np.zeros(dimensions, np.float32)
    for w in _TOKEN.findall((text or "").lower()):
        h = zlib.crc32(w.encode())
        v[h % dimensions] += 1.0 if h & 0x80000000 else -1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embed(df: DataFrame, text: str, model: Callable[[], Callable[[list[str]], list]] | None = None) -> DataFrame:
    """df with ``embedding``; ``model`` makes a batch encoder once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model() if model else lambda texts: [hashing_embedding(t) for t in texts]
        for s in batches:
            yield pd.Series(list(encode(list(s))))

    return df.withColumn("embedding", run(F.col(text)))


def where(language: str | None = None, symbol_type: str | None = None, file_path: str | None = None, risk_level: str | None = None, raw: str | None = None) -> Column | None:
    """Conjunction of the given equalities; a raw expression replaces them all; none gives None."""
    if raw:
        return F.expr(raw)
    given = {"language": language, "symbol_type": symbol_type, "file_path": file_path, "risk_level": risk_level}
    parts = [F.col(k) == v for k, v in given.items() if v is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, query: list[float], k: int = 5, condition: Column | None = None, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector; a zero vector finds none; ties go to the least key."""
    if not any(query):
        return rows.withColumn("distance", F.lit(0.0)).limit(0)
    if condition is not None:
        rows = rows.where(condition)
    q = np.asarray(query, np.float64)
    q = q / np.linalg.norm(q)

    @F.pandas_udf("double")
    def distance(column: pd.Series) -> pd.Series:
        out = np.full(len(column), np.nan)
        live = [i for i, v in enumerate(column) if v is not None and len(v) == len(q)]
        if live:
            x = np.stack([column.iloc[i] for i in live]).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[live] = np.where(norm > 0, 1 - (x @ q) / norm, np.nan)
        return pd.Series(out)

    return rows.withColumn("distance", distance(F.col(vector))).where("distance IS NOT NULL").orderBy("distance", key).limit(k)


def nearest_of_many(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", same: str | None = None) -> DataFrame:
    """query_id, key, rank, distance of the k nearest rows of each query, against all rows, without the query itself.

    queries are read in blocks of BLOCK vectors, and each block is sent to all partitions, which keep the k best of each
    query; with ``same`` only rows equal to the query in that column count.  Zero and null vectors find and are found by none.
    """
    spark = rows.sparkSession
    cols = [key, vector] + ([same] if same else [])
    data = rows.where(F.col(vector).isNotNull()).select(*cols)
    schema = f"query_id bigint, {key} bigint, distance double"
    parts, block = [], []

    def add(block: list) -> None:
        ids = np.asarray([r[0] for r in block], np.int64)
        q = np.asarray([r[1] for r in block], np.float64)
        n = np.linalg.norm(q, axis=1)
        live = n > 0
        shared = spark.sparkContext.broadcast((ids[live], q[live] / n[live, None], [r[2] for r, ok in zip(block, live) if ok] if same else None))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, tags = shared.value
            best = [[] for _ in ids]
            for b in it:
                keys = b.column(0).to_numpy()
                x = np.asarray(b.column(1).to_pylist(), np.float64).reshape(len(keys), -1)
                norm = np.linalg.norm(x, axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = 1 - q @ (x / norm[:, None]).T
                d[:, norm == 0] = np.inf
                d[ids[:, None] == keys[None, :]] = np.inf
                if tags is not None:
                    d[np.asarray(tags)[:, None] != np.asarray(b.column(2).to_pylist())[None, :]] = np.inf
                for i in range(len(ids)):
                    pick = np.lexsort((keys, np.round(d[i], 12)))[:k] if len(keys) <= 4 * k else (lambda c: c[np.lexsort((keys[c], d[i][c]))][:k])(np.flatnonzero(d[i] <= np.partition(d[i], k)[k]))
                    best[i] = sorted(set(best[i] + [(float(d[i, j]), int(keys[j])) for j in pick if np.isfinite(d[i, j])]))[:k]
            out = [(int(ids[i]), key_, dist) for i in range(len(ids)) for dist, key_ in best[i]]
            if out:
                a, c, e = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(e, pa.float64())], names=["query_id", key, "distance"])

        parts.append(data.mapInArrow(run, schema))

    for r in queries.where(F.col(vector).isNotNull()).select(*cols).toLocalIterator():
        block.append(tuple(r))
        if len(block) == BLOCK:
            add(block)
            block = []
    if block or not parts:
        add(block) if block else parts.append(spark.createDataFrame([], schema))
    every = reduce(DataFrame.unionAll, parts)
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", key, "rank", F.round("distance", 6).alias("distance"))
