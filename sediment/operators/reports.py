"""Reports: each section a table, and a renderer of tables to Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import graph as G
from . import score as C


def statistics(scored: DataFrame, totals: DataFrame, edges: DataFrame, tiers: DataFrame) -> DataFrame:
    """One row of figures per repository."""
    per = scored.groupBy("repo").agg(F.count("*").alias("files_scored"), *[F.count_if(F.col("risk_level") == x).alias(x.lower()) for x in C.LEVELS], F.round(F.coalesce(F.avg(F.when(F.col("avg_complexity") > 0, F.col("avg_complexity"))), F.lit(0.0)), 2).alias("mean_complexity"), F.count_if("in_cycle").alias("files_in_cycles"))
    arcs = edges.groupBy("repo").agg(F.count("*").alias("n_edges"))
    return tiers.join(totals, "repo", "left").join(per, "repo", "left").join(arcs, "repo", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def architecture(scored: DataFrame, deg: DataFrame, k: int = 15) -> DataFrame:
    """Files by the number of those that import them, with their risk (LOW where there is none)."""
    return deg.join(scored.select("file_id", "repo", "path", "risk_level"), "file_id", "left").where("in_degree > 0").orderBy(F.desc("in_degree"), "repo", "path").limit(k).select("repo", S.short_path(F.col("path")).alias("file"), "in_degree", "out_degree", C.risk_or(F.col("risk_level"), "LOW").alias("risk_level"))


def domain_classes(classes: DataFrame, deg: DataFrame, k: int = 15) -> DataFrame:
    """Classes of the most imported files."""
    rows = classes.join(deg.select("file_id", "in_degree"), "file_id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return rows.orderBy(F.desc("in_degree"), "repo", "path", "ord").limit(k).select("repo", "path", "name", F.size("method_names").alias("n_methods"), "in_degree")


def core_files(explained: DataFrame, deg: DataFrame, k: int = 10) -> DataFrame:
    """Ordered union without repeats: explained files first, then the most imported ones."""
    top = deg.where("in_degree > 0").orderBy(F.desc("in_degree"), "file_id").limit(k).select("file_id", F.lit(1).alias("part"), F.col("in_degree").alias("n"))
    both = explained.select("file_id", F.lit(0).alias("part"), F.lit(0).alias("n")).unionByName(top)
    return both.groupBy("file_id").agg(F.min(F.struct("part", (-F.col("n")).alias("o"))).alias("first")).orderBy("first", "file_id").select("file_id", F.col("first.part").alias("part"))


def filtered(scored: DataFrame, risk: str | None = None, text: str | None = None, sort: str = "risk") -> DataFrame:
    """The file table of a user interface: a risk level, a part of the path in any case, an order."""
    rows = scored.where(F.col("risk_level") == risk) if risk else scored
    rows = rows.where(F.contains(F.lower("path"), F.lit(text.lower()))) if text else rows
    order = {"risk": F.desc(S.risk_weight(F.col("risk_level"))), "max": F.desc("max_complexity"), "avg": F.desc("avg_complexity"), "functions": F.desc("n_functions"), "coupling": F.desc("coupling"), "path": F.asc("path")}[sort]
    return rows.orderBy(order, "repo", "path")


def bars(counts: DataFrame, value: str) -> DataFrame:
    """Values as percentages of the largest."""
    top = counts.agg(F.max(value).alias("top"))
    return counts.crossJoin(F.broadcast(top)).withColumn("percent", F.round(100 * F.col(value) / F.col("top")).cast("int")).drop("top")


def markdown(df: DataFrame, title: str, limit: int = 50, empty: str = "Nothing to report.") -> str:
    """A table of the first rows, numbered, with how many more there are."""
    rows = df.limit(limit + 1).collect()
    if not rows:
        return f"## {title}\n\n{empty}\n"
    cell = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v).replace("|", "\\|").replace("\n", " ")
    head = "| # | " + " | ".join(df.columns) + " |\n|" + "---|" * (len(df.columns) + 1)
    body = "\n".join(f"| {i} | " + " | ".join(cell(v) for v in r) + " |" for i, r in enumerate(rows[:limit], 1))
    return f"## {title}\n\n{head}\n{body}\n" + ("\nThere are more.\n" if len(rows) > limit else "")


def document(title: str, sections: dict[str, Callable[[], str]]) -> str:
    """Sections one behind the other; one that fails says so and does not stop the others."""
    out = [f"# {title}\n"]
    for name, make in sections.items():
        try:
            out.append(make())
        except Exception as e:  # noqa: BLE001
            out.append(f"## {name}\n\nThis section is not available ({type(e).__name__}).\n")
    return "\n".join(out)


def prompt(path: str, level: str, users: list[str], uses: list[str], code: str, head: int = 8) -> str:
    """What an explainer is asked about a file."""
    listed = lambda xs: ", ".join(xs[:head]) + (f" and {len(xs) - head} more" if len(xs) > head else "") if xs else "none"
    return f"File: {path}\nRisk: {level}\nUsed by: {listed(users)}\nUses: {listed(uses)}\n\n{code or '(no source is at hand)'}\n\nTell a newcomer what this file does, how it fits in and what to mind when changing it."


def impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.change_impact(nodes, edges)
