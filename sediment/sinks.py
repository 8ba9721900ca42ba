"""Results as files: JSON rows, Parquet stores, Markdown and HTML."""

from __future__ import annotations

import html
import math
import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import graph as G


def manifest_json(manifest: DataFrame) -> DataFrame:
    """repo, json: totals, languages and rows of the manifest."""
    lang = manifest.groupBy("repo", "language").agg(F.count("*").alias("n")).groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"))
    rows = manifest.groupBy("repo").agg(F.count("*").alias("total_files"), F.sort_array(F.collect_list(F.struct("path", "language", "size_bytes", "sha"))).alias("files"))
    return rows.join(lang, "repo").select("repo", F.to_json(F.struct("total_files", "languages", "files")).alias("json"))


def symbols_json(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo", "path", F.to_json(F.struct("language", "module_docstring", "functions", "classes", "imports", "parse_error", "parse_error_detail")).alias("json"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of nodes, edges and nodes in cycles."""
    n = nodes.agg(F.count_distinct("node").alias("n_nodes"))
    e = G.simple(edges).agg(F.count("*").alias("n_edges"))
    c = G.circular_nodes(nodes, edges).agg(F.count("*").alias("n_circular"))
    return n.crossJoin(e).crossJoin(c).select(F.to_json(F.struct("n_nodes", "n_edges", "n_circular")).alias("json"), "n_nodes", "n_edges", "n_circular")


def complexity_json(scored: DataFrame) -> DataFrame:
    """repo, json: a map of paths to statistics."""
    row = F.struct("risk_level", "avg_complexity", "max_complexity", "n_functions", "n_classes", "n_lines", "coupling", "risk_reasons")
    return scored.groupBy("repo").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("path"), row.alias("stats")))))).alias("json"))


def store(chunks: DataFrame, place: str) -> None:
    """Replace a chunk store, partitioned by repository."""
    chunks.write.mode("overwrite").partitionBy("repo").parquet(place)


def drop_store(spark: SparkSession, place: str) -> bool:
    """Remove a chunk store; False if there was none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_store(spark: SparkSession, place: str) -> DataFrame:
    """The chunks of a store; a place that holds none is an error of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"no chunk store at {place}")
    return spark.read.parquet(place)


def store_info(chunks: DataFrame, job: str) -> DataFrame:
    """repo, json: name of the collection and number of chunks of each repository's store."""
    n = chunks.groupBy("repo").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    return n.select("repo", F.to_json(F.struct(S.collection_name(F.col("repo"), F.lit(job)).alias("collection"), "n_chunks")).alias("json"))


def store_count(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo").agg(F.count_distinct("chunk_id").alias("n_chunks"))


def explanations_json(explanations: DataFrame) -> DataFrame:
    return explanations.groupBy("repo").agg(F.count("*").alias("n"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "explanation"))))).alias("json"))


def write_text(text: str, place: str) -> str:
    """Write a report; an empty one is not written."""
    if not text:
        return ""
    Path(place).parent.mkdir(parents=True, exist_ok=True)
    Path(place).write_text(text, encoding="utf-8")
    return place


def graph_html(nodes: DataFrame, edges: DataFrame, limit: int = 2000) -> str:
    """A page that draws a graph: nodes on rings, the best connected innermost, coloured and sized by node_style, with all edges
    between the nodes shown.  A page has at most ``limit`` nodes, those of highest degree, and says how many it leaves out."""
    deg = G.degrees(nodes, edges)
    shown = deg.orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "node").limit(limit)
    rows = G.node_style(shown, G.circular_nodes(nodes, edges)).join(shown, "node").orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "node").collect()
    arcs = G.simple(edges).join(shown.select(F.col("node").alias("src")), "src", "left_semi").join(shown.select(F.col("node").alias("dst")), "dst", "left_semi").orderBy("src", "dst").collect()
    at, ring, left = {}, 0, list(rows)
    while left:
        part, left = left[: max(1, 8 * ring)], left[max(1, 8 * ring) :]
        for i, r in enumerate(part):
            angle = 2 * math.pi * i / len(part)
            at[r["node"]] = (round(90 * ring * math.cos(angle), 1), round(90 * ring * math.sin(angle), 1))
        ring += 1
    span = 90 * ring + 60
    lines = "".join(f'<line x1="{at[e["src"]][0]}" y1="{at[e["src"]][1]}" x2="{at[e["dst"]][0]}" y2="{at[e["dst"]][1]}"/>' for e in arcs)
    dots = "".join(f'<circle cx="{at[r["node"]][0]}" cy="{at[r["node"]][1]}" r="{r["size"] / 2}" fill="{html.escape(r["color"])}"><title>{html.escape(str(r["node"]))}: imported by {r["in_degree"]}, imports {r["out_degree"]}</title></circle>' for r in rows)
    rest = deg.count() - len(rows)
    note = f"<p>{rest} more files are not shown.</p>" if rest else ""
    style = "<style>line{stroke:#999;stroke-width:0.5}p{font-family:sans-serif}</style>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8">{style}</head><body>{note}<svg xmlns="http://www.w3.org/2000/svg" viewBox="{-span} {-span} {2 * span} {2 * span}">{lines}{dots}</svg></body></html>'


@contextmanager
def phase(name: str, log=print) -> Iterator[None]:
    """Say when a phase begins, how long it took and how much memory the driver's Python has held at most."""
    start = time.time()
    log(f"{name} begins")
    try:
        yield
    finally:
        log(f"{name} took {time.time() - start:.1f} s, at most {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024:.0f} MB so far")
