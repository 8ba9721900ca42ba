"""Complexity of files and their risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PARSEABLE, Risk

LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def function_scores(rows: DataFrame) -> DataFrame:
    """rows(file_id, ord, function, complexity) with one row per function name: the highest complexity, the first place."""
    return rows.where("complexity IS NOT NULL").groupBy("file_id", "function").agg(F.max("complexity").alias("complexity"), F.min("ord").alias("ord"))


def file_complexity(scores: DataFrame) -> DataFrame:
    """Mean and highest complexity of each file and its worst function; ties go to the first function."""
    return scores.groupBy("file_id").agg(F.round(F.avg("complexity"), 2).alias("avg_complexity"), F.max("complexity").alias("max_complexity"), F.max_by("function", F.struct("complexity", (-F.col("ord")).alias("o"), "function")).alias("worst_function"))


def score_map(scores: DataFrame) -> DataFrame:
    """file_id, function_scores: a map of functions to complexities."""
    return scores.groupBy("file_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("function", "complexity")))).alias("function_scores"))


def risk(risk: Risk | None = None, **columns: Column) -> tuple[Column, Column]:
    """Level and reasons from avg, max, coupling, undocumented, n_functions, parse_error, in_cycle and lines.

    Any signal of a level is enough; reasons are those of the level alone; null signals do not fire.
    """
    r = risk or Risk()
    c = {k: columns.get(k, F.col(k)) for k in ("avg", "max", "coupling", "undocumented", "n_functions", "parse_error", "in_cycle", "lines")}
    bare = lambda bound: (c["n_functions"] >= r.least_functions) & (c["undocumented"] >= bound)
    share = F.format_string("%.0f%% of functions lack documentation", 100 * c["undocumented"])
    signals = {
        "CRITICAL": [(c["parse_error"], F.lit("the file does not parse")), (c["in_cycle"], F.lit("part of an import cycle")), (c["max"] >= r.critical_max, F.format_string("a function has complexity %d", c["max"].cast("int")))],
        "HIGH": [(c["max"] >= r.high_max, F.format_string("a function has complexity %d", c["max"].cast("int"))), (c["avg"] >= r.high_avg, F.format_string("mean complexity %.1f", c["avg"].cast("double"))), (c["coupling"] >= r.high_coupling, F.format_string("imports %d files of the repository", c["coupling"].cast("int"))), (bare(r.high_undocumented), share), (c["lines"] >= r.high_lines, F.format_string("%d lines", c["lines"].cast("int")))],
        "MEDIUM": [(c["avg"] >= r.medium_avg, F.format_string("mean complexity %.1f", c["avg"].cast("double"))), (c["coupling"] >= r.medium_coupling, F.format_string("imports %d files of the repository", c["coupling"].cast("int"))), (bare(r.medium_undocumented), share), (c["lines"] >= r.medium_lines, F.format_string("%d lines", c["lines"].cast("int")))],
    }
    any_of = lambda level: F.coalesce(F.array_max(F.array(*[F.coalesce(x.cast("boolean"), F.lit(False)) for x, _ in signals[level]])), F.lit(False))
    said = lambda level: F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), text) for x, text in signals[level]]))
    level = F.when(any_of("CRITICAL"), "CRITICAL").when(any_of("HIGH"), "HIGH").when(any_of("MEDIUM"), "MEDIUM").otherwise("LOW")
    none = F.array().cast("array<string>")
    return level, F.when(any_of("CRITICAL"), said("CRITICAL")).when(any_of("HIGH"), said("HIGH")).when(any_of("MEDIUM"), said("MEDIUM")).otherwise(none)


def scores(manifest: DataFrame, counts: DataFrame, complexity: DataFrame, coupling: DataFrame, circular: DataFrame, errors: DataFrame, analyzed: DataFrame | None = None) -> DataFrame:
    """One row per file of the manifest with lines, in a language that is scored: statistics, risk level and reasons.

    counts: file_counts of the symbols; coupling(file_id, coupling); circular(file_id); errors(file_id, parse_error).
    A file that the graph lacks is coupled by the number of its internal imports.  analyzed(file_id): only these are scored.
    """
    manifest = manifest.where(F.col("language").isin(*PARSEABLE))
    if analyzed is not None:
        manifest = manifest.join(analyzed.select("file_id"), "file_id", "left_semi")
    rows = manifest.select("file_id", "repo", "path", "language", "n_lines").join(counts.select("file_id", "n_functions", "n_classes", "avg_function_lines", "n_undocumented", "undocumented_ratio", "n_internal_imports"), "file_id").join(complexity, "file_id", "left").join(coupling, "file_id", "left").join(circular.select("file_id").distinct().withColumn("in_cycle", F.lit(True)), "file_id", "left").join(errors, "file_id", "left")
    rows = rows.withColumns({"avg_complexity": F.coalesce("avg_complexity", F.lit(0.0)), "max_complexity": F.coalesce("max_complexity", F.lit(0.0)), "coupling": F.coalesce("coupling", "n_internal_imports"), "in_cycle": F.coalesce("in_cycle", F.lit(False)), "parse_error": F.coalesce("parse_error", F.lit(False))})
    level, reasons = risk(avg=F.col("avg_complexity"), max=F.col("max_complexity"), undocumented=F.col("undocumented_ratio"), lines=F.col("n_lines"))
    return rows.withColumn("risk_level", level).withColumn("risk_reasons", reasons).drop("n_internal_imports")


def risk_distribution(scored: DataFrame) -> DataFrame:
    """repo, risk_level, n_files with a row for every level, also those without files."""
    each = scored.groupBy("repo").agg(*[F.count_if(F.col("risk_level") == x).alias(x) for x in LEVELS])
    return each.select("repo", F.explode(F.array(*[F.struct(F.lit(x).alias("risk_level"), F.col(x).alias("n_files")) for x in LEVELS])).alias("r")).select("repo", "r.*")


def repo_mean(scored: DataFrame) -> DataFrame:
    """Mean of the files' mean complexities that are not zero; sums are whole hundredths, so their order does not matter."""
    hundredths = F.when(F.col("avg_complexity") > 0, F.round(F.col("avg_complexity") * 100).cast("bigint"))
    return scored.groupBy("repo").agg(F.round(F.coalesce(F.try_divide(F.sum(hundredths), F.count_if(F.col("avg_complexity") > 0)), F.lit(0.0)) / 100, 2).alias("mean_complexity"))


def by_risk(scored: DataFrame) -> DataFrame:
    """Files of each level, the most complex first."""
    row = F.struct((-F.col("max_complexity")).alias("o"), "path", "file_id")
    return scored.groupBy("repo", "risk_level").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["path"]).alias("paths"))


def complex_functions(scores_: DataFrame, least: float = 10) -> DataFrame:
    return scores_.where(F.col("complexity") >= least)


def top_functions(scores_: DataFrame, k: int = 10) -> DataFrame:
    return scores_.orderBy(F.desc("complexity"), "file_id", "ord", "function").limit(k).select("file_id", "function", "complexity")


def top_risky(scored: DataFrame, levels: tuple[str, ...] = ("CRITICAL", "HIGH"), k: int = 15) -> DataFrame:
    """The most complex files of the given levels, the gravest level first."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("risk_level"))
    return scored.where(F.col("risk_level").isin(*levels)).orderBy(rank, F.desc("max_complexity"), "repo", "path").limit(k).select("repo", "path", "risk_level", "max_complexity")


def safe_files(scored: DataFrame, deg: DataFrame, k: int = 10) -> DataFrame:
    """Files of low risk that parse, the least connected first; deg(file_id, in_degree, out_degree)."""
    return scored.where("risk_level = 'LOW' AND NOT parse_error").join(deg, "file_id").orderBy("in_degree", "out_degree", "repo", "path").limit(k).select("repo", "path", "in_degree", "out_degree")


def risk_or(level: Column, default: str | None) -> Column:
    """Level of files that may not be scored: LOW in graphs and the API, "?" in tables, null in statistics."""
    return F.coalesce(level, F.lit(default))
