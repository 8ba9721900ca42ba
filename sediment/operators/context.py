"""What is explained and within which budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 8000
LEAST_REST = 300
CUT = "\n# ... (cut)"
SEPARATOR = "\n\n"


def tier(level: Column, in_degree: Column) -> Column:
    return F.when(level == "CRITICAL", 0).when(in_degree >= 5, 1).when(level == "HIGH", 2).when(in_degree >= 2, 3).when(level == "MEDIUM", 4).otherwise(5)


def selected(scored: DataFrame, deg: DataFrame, k: int = 20) -> DataFrame:
    """Files to explain, per repository: by tier, then by dependents."""
    rows = scored.join(deg.select("file_id", "in_degree"), "file_id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0))).withColumn("tier", tier(F.col("risk_level"), F.col("in_degree")))
    w = Window.partitionBy("repo").orderBy("tier", F.desc("in_degree"), "path")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select("repo", "position", "path", "tier", "in_degree", "risk_level")


def budgeted(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """chunks with order, length, sum so far and fate: full, cut or dropped.

    Order of a file: module, functions from the most complex, classes.  Chunks are full as long as their lengths fit; the
    first that does not is cut if more than LEAST_REST characters are left; everything behind it is dropped.
    """
    kind = F.when(F.col("symbol_type") == "module", 0).when(F.col("symbol_type") == "function", 1).otherwise(2)
    w = Window.partitionBy("repo", "file_path").orderBy("kind", F.desc("cc"), "line_start", "chunk_no")
    rows = chunks.dropDuplicates(["chunk_no"]).withColumns({"kind": kind, "cc": F.when(kind == 1, F.coalesce("complexity", F.lit(0.0))).otherwise(F.lit(0.0)), "n_chars": F.length(F.coalesce("content", F.lit("")))})
    rows = rows.withColumns({"position": F.row_number().over(w), "used": F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    before = F.col("used") - F.col("n_chars")
    first = (F.col("used") > budget) & (before <= budget)
    fate = F.when(F.col("used") <= budget, "full").when(first & (budget - before > LEAST_REST), "cut").otherwise("dropped")
    return rows.withColumn("fate", fate).withColumn("kept_chars", F.when(fate == "full", F.col("n_chars")).when(fate == "cut", budget - before).otherwise(0)).drop("kind", "cc")


def assembled(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """repo, file_path, context, n_dropped: the text of each file's chunks within the budget."""
    b = budgeted(chunks, budget)
    piece = F.when(F.col("fate") == "full", F.col("content")).when(F.col("fate") == "cut", F.concat(F.expr("substr(content, 1, kept_chars)"), F.lit(CUT)))
    g = b.withColumn("piece", piece).groupBy("repo", "file_path").agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("position", "piece")))).alias("ps"), F.count_if(F.col("fate") == "dropped").alias("n_dropped"))
    tail = F.when(F.col("n_dropped") > 0, F.format_string("# ... %d more chunks are not shown", "n_dropped"))
    return g.select("repo", "file_path", F.concat_ws(SEPARATOR, F.array_join(F.transform("ps", lambda p: p["piece"]), SEPARATOR), tail).alias("context"), "n_dropped")
