"""Views of the symbol table: functions, classes, imports, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tables(symbols: DataFrame) -> DataFrame:
    """One row per file."""
    return symbols.dropDuplicates(["file_id"])


def functions(symbols: DataFrame) -> DataFrame:
    return tables(symbols).select("file_id", "repo", "path", F.posexplode("functions").alias("ord", "f")).select("file_id", "repo", "path", "ord", "f.*")


def classes(symbols: DataFrame) -> DataFrame:
    return tables(symbols).select("file_id", "repo", "path", F.posexplode("classes").alias("ord", "c")).select("file_id", "repo", "path", "ord", "c.*")


def imports(symbols: DataFrame) -> DataFrame:
    return tables(symbols).select("file_id", "repo", "path", "language", F.posexplode("imports").alias("ord", "i")).select("file_id", "repo", "path", "language", "ord", "i.*")


def undocumented(symbols: DataFrame) -> DataFrame:
    return functions(symbols).where("docstring IS NULL OR docstring = ''")


def totals(symbols: DataFrame) -> DataFrame:
    """Functions, classes, internal imports, undocumented functions and files with errors of each repository."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).cast("bigint")
    few = lambda c, p: F.coalesce(F.sum(F.size(F.filter(c, p))), F.lit(0)).cast("bigint")
    return tables(symbols).groupBy("repo").agg(
        F.count("*").alias("n_files"),
        n("functions").alias("n_functions"),
        n("classes").alias("n_classes"),
        few("imports", lambda i: i["is_internal"]).alias("n_internal_imports"),
        few("functions", lambda f: F.coalesce(f["docstring"], F.lit("")) == "").alias("n_undocumented"),
        F.count_if(F.coalesce("parse_error", F.lit(False))).alias("n_parse_errors"),
    )


def file_counts(symbols: DataFrame) -> DataFrame:
    """Function statistics of each file; ratios are 0 and mean lengths 0 where there is no function."""
    fs = F.col("functions")
    n = F.when(fs.isNull(), 0).otherwise(F.size(fs))
    lines = F.aggregate(F.transform(fs, lambda f: (f["line_end"] - f["line_start"] + 1).cast("double")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    bare = F.size(F.filter(fs, lambda f: F.coalesce(f["docstring"], F.lit("")) == ""))
    rows = tables(symbols).select("file_id", "repo", "path", n.alias("n_functions"), F.when(F.col("classes").isNull(), 0).otherwise(F.size("classes")).alias("n_classes"), lines.alias("lines"), F.when(fs.isNull(), 0).otherwise(bare).alias("n_undocumented"), F.coalesce(F.size(F.filter("imports", lambda i: i["is_internal"])), F.lit(0)).alias("n_internal_imports"))
    return rows.select("file_id", "repo", "path", "n_functions", "n_classes", (F.col("n_functions") + F.col("n_classes")).alias("n_symbols"), F.round(F.coalesce(F.try_divide("lines", "n_functions"), F.lit(0.0)), 1).alias("avg_function_lines"), "n_undocumented", F.round(F.coalesce(F.try_divide("n_undocumented", "n_functions"), F.lit(0.0)), 3).alias("undocumented_ratio"), "n_internal_imports")
