"""Chunks of files: one for the module's head, one per function, one per class.  All built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNKABLE
from ..functions import scalar as S

CLASS_LINES = 16


def make_chunks(contents: DataFrame, symbols: DataFrame, languages: tuple[str, ...] = CHUNKABLE, analyzed: DataFrame | None = None) -> DataFrame:
    """chunk_id, file_id, repo, file_path, symbol_name, symbol_type, language, line_start, line_end, content.

    Files without content, that do not parse or are of other languages have no chunks; with analyzed(file_id) only these have.
    A file's texts meet its symbols on file_id; of texts delivered twice one is taken as they meet, so only one exchange moves them.
    """
    if analyzed is not None:
        symbols = symbols.join(analyzed.select("file_id"), "file_id", "left_semi")
    text = contents.select("file_id", "content").where("content IS NOT NULL AND content <> ''").dropDuplicates(["file_id"])
    sym = symbols.dropDuplicates(["file_id"]).withColumn("language", S.language(F.col("path"))).where(F.col("language").isin(*languages) & ~F.coalesce("parse_error", F.lit(False)))
    rows = text.join(sym.select("file_id", "repo", "path", "language", "module_docstring", "functions", "classes", "imports").hint("shuffle_hash"), "file_id")
    line = lambda i: F.when(i["is_from_import"], F.concat(F.lit("from "), i["module"], F.lit(" import "), F.when(F.size(i["names"]) > 0, F.array_join(i["names"], ", ")).otherwise(F.lit("*")))).otherwise(F.concat(F.lit("import "), i["module"]))
    doc = F.when(F.coalesce("module_docstring", F.lit("")) != "", F.concat(F.lit('"""'), F.col("module_docstring"), F.lit('"""')))
    head = F.concat_ws("\n\n", doc, F.when(F.size("imports") > 0, F.array_join(F.transform("imports", line), "\n")))
    module = F.when(head != "", F.array(F.struct(F.element_at(F.split("path", "/"), -1).alias("symbol_name"), F.lit("module").alias("symbol_type"), F.lit(1).alias("line_start"), F.least(F.lit(30), F.size(F.split(head, "\n"))).alias("line_end"), F.concat(F.lit("# MODULE: "), F.col("path"), F.lit("\n"), head).alias("content")))).otherwise(F.array())
    body = lambda s, e: S.lines_between(F.col("content"), s, e)
    function = F.transform("functions", lambda f: F.struct(f["name"].alias("symbol_name"), F.lit("function").alias("symbol_type"), f["line_start"].alias("line_start"), f["line_end"].alias("line_end"), F.concat(F.lit("# "), f["name"], F.lit(" ("), F.col("path"), F.lit(")\n"), body(f["line_start"], f["line_end"])).alias("content")))
    last = lambda c: F.least(c["line_start"] + CLASS_LINES - 1, c["line_end"])
    klass = F.transform("classes", lambda c: F.struct(c["name"].alias("symbol_name"), F.lit("class").alias("symbol_type"), c["line_start"].alias("line_start"), last(c).alias("line_end"), F.concat(F.lit("# class "), c["name"], F.lit(" ("), F.col("path"), F.lit(")\n"), body(c["line_start"], last(c))).alias("content")))
    kind = "array<struct<symbol_name:string,symbol_type:string,line_start:int,line_end:int,content:string>>"
    each = rows.select("file_id", "repo", "path", "language", F.explode(F.concat(module.cast(kind), F.coalesce(function.cast(kind), F.array().cast(kind)), F.coalesce(klass.cast(kind), F.array().cast(kind)))).alias("c")).select("file_id", "repo", F.col("path").alias("file_path"), "language", "c.*")
    name = F.when(F.col("symbol_type") == "module", F.lit("module")).otherwise(F.col("symbol_name"))
    return each.select(S.chunk_id(F.col("file_path"), name, F.col("line_start"), F.col("symbol_type")).alias("chunk_id"), "file_id", "repo", "file_path", "symbol_name", "symbol_type", "language", "line_start", "line_end", "content")


def with_complexity(chunks: DataFrame, scores: DataFrame, levels: DataFrame) -> DataFrame:
    """Chunks with the complexity of their function and their file's risk.

    scores(file_id, function, complexity, ord): by the name itself, else the first that ends in ".name"; levels(file_id, risk_level).
    """
    own = scores.select("file_id", F.col("function").alias("symbol_name"), F.col("complexity").alias("c1"))
    method = scores.where(F.col("function").contains(".")).select("file_id", F.substring_index("function", ".", -1).alias("symbol_name"), "complexity", "ord").groupBy("file_id", "symbol_name").agg(F.min_by("complexity", "ord").alias("c2"))
    rows = chunks.join(own, ["file_id", "symbol_name"], "left").join(method, ["file_id", "symbol_name"], "left").join(levels, "file_id", "left")
    return rows.withColumn("complexity", F.when(F.col("symbol_type") == "function", F.coalesce("c1", "c2"))).withColumn("risk_level", F.when(F.col("symbol_type") != "module", F.col("risk_level"))).drop("c1", "c2")


def stats(chunks: DataFrame) -> DataFrame:
    """Chunks by type and language, with totals of each (grouping sets)."""
    return chunks.select("repo", "chunk_id", "symbol_type", "language").distinct().groupingSets([["symbol_type", "language"], ["symbol_type"], ["language"], []], "symbol_type", "language").agg(F.count("*").alias("n_chunks"))


def to_sentinels(chunks: DataFrame) -> DataFrame:
    """The store's form: unknown complexity -1, unknown risk UNKNOWN."""
    return chunks.withColumns({"complexity": F.coalesce("complexity", F.lit(-1.0)), "risk_level": F.coalesce("risk_level", F.lit("UNKNOWN"))})


def from_sentinels(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"complexity": F.nullif("complexity", F.lit(-1.0)), "risk_level": F.nullif("risk_level", F.lit("UNKNOWN"))})


def file_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """The chunks of one file in order, as hits at distance 0."""
    return chunks.where(F.col("file_path") == path).orderBy("line_start", "chunk_id").withColumn("distance", F.lit(0.0))
