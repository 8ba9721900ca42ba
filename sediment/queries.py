"""Queries of the analytics operators over the driver's tables, and their SQL.

Queries run over whole tables.  Where imports of the tables do not form a graph of interest, graphs are built from keys:
``file_edges`` (file n imports n div 2 and n div 3, acyclic), ``file_links`` (the same with keyed edges back, cyclic, in small
components) and ``trade`` (nations and their two best partners, cyclic, 25 nodes at every size).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import EXCLUDED_DIRS, EXCLUDED_NAMES, LANGUAGES, MAX_FILE_BYTES, PHASES, Limits
from .functions import scalar as S
from .operators import cache as H
from .operators import chunks as K
from .operators import context as X
from .operators import graph as G
from .operators import jobs as J
from .operators import manifest as M
from .operators import reports as R
from .operators import resolve as V
from .operators import retrieve as T
from .operators import score as C
from .operators import sections as N
from .operators import symbols as Y
from .parsing import driver as P
from . import sinks

Query = Callable[[SparkSession, str], DataFrame]
#: Small bounds for queries whose feature is a bound, so that the tables reach them.
CAP = Limits(full=20, warning=60, sampled=100)
ROUNDS = 30


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def file_nodes(s: SparkSession, d: str) -> DataFrame:
    return M.manifest(t(s, d, "files")).select(F.col("file_id").alias("node"))


def file_edges(s: SparkSession, d: str) -> DataFrame:
    n = file_nodes(s, d)
    e = n.select(F.col("node").alias("src"), F.explode(F.array(F.expr("node div 2"), F.expr("node div 3"))).alias("dst")).where("src <> dst").distinct()
    return e.join(n.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def file_links(s: SparkSession, d: str) -> DataFrame:
    """file_edges, and edges back that close cycles of two (n of 7 mod 32 and n div 2) and three files (n of 13 mod 64, n div 2 and n div 4)."""
    n = file_nodes(s, d)
    back = n.select(F.expr("CASE WHEN node % 32 = 7 THEN node div 2 WHEN node % 64 = 13 THEN node div 4 END").alias("src"), F.col("node").alias("dst")).where("src IS NOT NULL").distinct()
    return file_edges(s, d).unionByName(back.join(n.select(F.col("node").alias("src")), "src", "left_semi")).distinct()


def trade_nodes(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))


def trade(s: SparkSession, d: str) -> DataFrame:
    """Each supplier nation and its two customer nations of highest revenue."""
    line = t(s, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    sup = t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("src"))
    cust = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("bigint").alias("dst"))
    g = line.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(cust, F.col("l_orderkey") == F.col("o_orderkey")).where("src <> dst").groupBy("src", "dst").agg(F.round(F.sum("rev"), 2).alias("rev"))
    w = Window.partitionBy("src").orderBy(F.desc("rev"), "dst")
    return g.withColumn("n", F.row_number().over(w)).where("n <= 2").select("src", "dst")


def function_rows(s: SparkSession, d: str) -> DataFrame:
    """Functions with known complexity, from the chunks."""
    c = t(s, d, "chunks").where("symbol_type = 'function' AND complexity IS NOT NULL").dropDuplicates(["chunk_no"])
    return C.function_scores(c.select("file_id", F.col("chunk_no").alias("ord"), F.col("symbol_name").alias("function"), "complexity"))


def scored(s: SparkSession, d: str) -> DataFrame:
    files, contents, symbols = t(s, d, "files"), t(s, d, "contents"), t(s, d, "symbols")
    nodes, edges = file_nodes(s, d), file_edges(s, d)
    coupling = G.degrees(nodes, edges).select(F.col("node").alias("file_id"), F.col("out_degree").alias("coupling"))
    errors = symbols.groupBy("file_id").agg(F.max(F.coalesce("parse_error", F.lit(False))).alias("parse_error"))
    none = nodes.select(F.col("node").alias("file_id")).limit(0)
    return C.scores(M.with_lines(files, contents), Y.file_counts(symbols), C.file_complexity(function_rows(s, d)), coupling, none, errors)


def node_degrees(s: SparkSession, d: str) -> DataFrame:
    return G.degrees(file_nodes(s, d), file_edges(s, d)).withColumnRenamed("node", "file_id")


def cache_rows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files with owner and name, and a cache that holds the explanations of all files of one language."""
    repos = t(s, d, "repos").select("repo", "owner", "repo_name").distinct()
    files = M.manifest(t(s, d, "files")).join(repos, "repo")
    kept = H.keyed(files).where("language = 'Python' AND cache_key IS NOT NULL").select("cache_key", F.concat(F.lit("about "), "path").alias("explanation"))
    return files, kept


def late_imports(s: SparkSession, d: str) -> DataFrame:
    return Y.imports(t(s, d, "symbols")).withColumn("language", S.language(F.col("path")))


def path_imports(s: SparkSession, d: str) -> DataFrame:
    """Imports that resolve, made of the paths: of a repository's Python files, and of its JavaScript and TypeScript files, in order
    of path, number n imports number n div 2; those of 4 mod 5 are imported back, which closes cycles."""
    family = F.when(F.col("path").rlike(r"\.py$"), "Python").when(F.col("path").rlike(r"\.(js|jsx|mjs|cjs|ts|tsx)$"), "TypeScript")
    rows = M.manifest(t(s, d, "files")).select("file_id", "repo", "path", family.alias("family")).where("family IS NOT NULL")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("repo", "family").orderBy("path")))
    to = rows.select("repo", "family", F.col("r").alias("r2"), F.regexp_replace("path", r"\.[A-Za-z]+$", "").alias("stem"))
    down = rows.where("r >= 2").withColumn("r2", F.expr("r div 2")).join(to, ["repo", "family", "r2"])
    back = to.where("r2 % 5 = 4").withColumn("r", F.expr("r2 div 2")).join(rows, ["repo", "family", "r"]).select(*down.columns)
    up = F.size(F.split("path", "/")) - 1
    module = F.when(F.col("family") == "Python", F.replace(F.col("stem"), F.lit("/"), F.lit("."))).otherwise(F.concat(F.when(up > 0, F.expr("repeat('../', size(split(path, '/')) - 1)")).otherwise("./"), "stem"))
    both = down.unionByName(back).withColumn("module", module)
    ord_ = F.row_number().over(Window.partitionBy("file_id").orderBy("module")) - 1
    return both.select("file_id", ord_.alias("ord"), "repo", "path", F.col("family").alias("language"), "module", F.array().cast("array<string>").alias("names"), F.lit(True).alias("is_internal"))


def import_graph(s: SparkSession, d: str) -> DataFrame:
    """src, dst by file_id of the resolved imports of paths."""
    ids = M.manifest(t(s, d, "files")).select("repo", "path", "file_id")
    e = V.edges(path_imports(s, d), ids)
    a, b = ids.select("repo", F.col("path").alias("src"), F.col("file_id").alias("s")), ids.select("repo", F.col("path").alias("dst"), F.col("file_id").alias("d"))
    return e.join(a, ["repo", "src"]).join(b, ["repo", "dst"]).select(F.col("s").alias("src"), F.col("d").alias("dst"))


def facts(s: SparkSession, d: str) -> N.Facts:
    """The tables as facts for reports, on the graph of resolved imports; a module's docstring serves as its file's explanation."""
    files, contents, symbols = t(s, d, "files"), t(s, d, "contents"), t(s, d, "symbols")
    man = M.manifest(files)

    @cache
    def components() -> DataFrame:
        return G.cut(G.components(file_nodes(s, d), f.edges))

    def circular() -> DataFrame:
        return G.circular_nodes(file_nodes(s, d), f.edges, components()).withColumnRenamed("node", "file_id")

    def scored_() -> DataFrame:
        coupling = f.degrees.select("file_id", F.col("out_degree").alias("coupling"))
        errors = symbols.groupBy("file_id").agg(F.max(F.coalesce("parse_error", F.lit(False))).alias("parse_error"))
        return G.cut(C.scores(M.with_lines(files, contents), Y.file_counts(symbols), C.file_complexity(f.functions), coupling, circular(), errors))

    def order() -> DataFrame:
        ring = circular().join(f.nodes, "file_id").select("repo").distinct()
        kept = f.nodes.join(ring, "repo", "left_anti").select("file_id")
        e = f.edges.join(kept.select(F.col("file_id").alias("src")), "src", "left_semi").join(kept.select(F.col("file_id").alias("dst")), "dst", "left_semi")
        return G.levels(kept.withColumnRenamed("file_id", "node"), e).withColumnRenamed("node", "file_id")

    f = N.Facts(
        repos=lambda: t(s, d, "repos").groupBy("repo").agg(F.min("repo_url").alias("repo_url"), F.max("default_branch").alias("default_branch")),
        tiers=lambda: M.analysis_tiers(files),
        languages=lambda: M.language_breakdown(files, True),
        totals=lambda: Y.totals(symbols),
        scored=scored_,
        nodes=lambda: man.select("file_id", "repo", "path"),
        degrees=lambda: G.cut(G.degrees(file_nodes(s, d), f.edges).withColumnRenamed("node", "file_id")),
        edges=lambda: G.cut(import_graph(s, d)),
        cycles=lambda: G.cut(G.cycles(file_nodes(s, d), f.edges, known=components()).select("nodes", "length")),
        order=order,
        classes=lambda: Y.classes(symbols),
        functions=lambda: function_rows(s, d),
        explanations=lambda: symbols.where("module_docstring IS NOT NULL").groupBy("file_id").agg(F.max("module_docstring").alias("explanation")),
    )
    return f


def queries() -> dict[str, Query]:
    def col(fn, table, keep, name):
        return lambda s, d: t(s, d, table).select(*keep, fn().alias(name)).distinct()

    q: dict[str, Query] = {
        # sources and paths
        "repo_url_parts": lambda s, d: t(s, d, "repos").select("repo", S.repo_parts(F.col("repo_url")).alias("p")).select("repo", "p.owner", "p.name").distinct(),
        "basename": col(lambda: S.basename(F.col("path")), "files", ["file_id"], "base"),
        "short_path": col(lambda: S.short_path(F.col("path")), "files", ["file_id"], "short"),
        "path_depth": col(lambda: S.path_depth(F.col("path")), "files", ["file_id"], "depth"),
        "path_parent": col(lambda: S.parent(F.col("path")), "files", ["file_id"], "parent"),
        "path_normalize": lambda s, d: t(s, d, "files").select("file_id", S.normalized(F.concat(S.parent(F.col("path")), F.lit("/./x/../../"), S.basename(F.col("path")))).alias("target")).distinct(),
        "anchor_slug": col(lambda: S.anchor(F.col("path")), "files", ["file_id"], "slug"),
        "collection_name": col(lambda: S.collection_name(F.col("repo"), F.lit("job-7")), "repos", ["repo"], "collection"),
        "chunk_ids": lambda s, d: t(s, d, "chunks").select("chunk_no", S.chunk_id(F.col("file_path"), F.when(F.col("symbol_type") == "module", "module").otherwise(F.col("symbol_name")), F.col("line_start"), F.col("symbol_type")).alias("chunk_id")).distinct(),
        "first_sentence": lambda s, d: t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(S.sentences(F.col("text"), 1), 256).alias("sentence_sha")),
        "first_two_sentences": lambda s, d: t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(S.sentences(F.col("text"), 2), 256).alias("sentence_sha")),
        # manifest
        "manifest_filter": lambda s, d: M.manifest(t(s, d, "files")).select("file_id", "repo", "path", "language"),
        "line_counts": lambda s, d: M.with_lines(t(s, d, "files"), t(s, d, "contents")).select("file_id", "n_lines"),
        "language_breakdown": lambda s, d: M.language_breakdown(t(s, d, "files")),
        "code_languages": lambda s, d: M.language_breakdown(t(s, d, "files"), True),
        "primary_language": lambda s, d: M.primary_language(t(s, d, "files")),
        "analysis_tier": lambda s, d: M.analysis_tiers(t(s, d, "files"), CAP),
        "manifest_cap": lambda s, d: M.capped(t(s, d, "files"), CAP).select("repo", "position", "path"),
        # symbols
        "symbol_totals": lambda s, d: Y.totals(t(s, d, "symbols")),
        "symbol_counts": lambda s, d: Y.file_counts(t(s, d, "symbols")).select("file_id", "n_functions", "n_classes", "n_symbols", "avg_function_lines", "n_undocumented", "undocumented_ratio"),
        "undocumented_functions": lambda s, d: Y.undocumented(t(s, d, "symbols")).select("file_id", "ord", "name"),
        "class_table": lambda s, d: Y.classes(t(s, d, "symbols")).select("file_id", "ord", "name", F.size("method_names").alias("n_methods")),
        "import_table": lambda s, d: Y.imports(t(s, d, "symbols")).select("file_id", "ord", "module", F.array_join("names", ",").alias("names"), "is_internal"),
        # imports
        "import_candidates": lambda s, d: V.candidates(late_imports(s, d)).select("file_id", "ord", "part", "pref", "target"),
        "import_edges": lambda s, d: V.edges(path_imports(s, d), M.manifest(t(s, d, "files"))),
        "import_edges_given": lambda s, d: V.edges(late_imports(s, d), M.manifest(t(s, d, "files"))),
        "import_degrees": lambda s, d: G.degrees(file_nodes(s, d), import_graph(s, d)),
        "import_circular": lambda s, d: G.circular_nodes(file_nodes(s, d), import_graph(s, d)),
        "import_isolated": lambda s, d: G.isolated(file_nodes(s, d), import_graph(s, d)),
        "import_internal": lambda s, d: V.is_internal(late_imports(s, d), t(s, d, "files")).select("file_id", "ord", "internal"),
        "import_unresolved": lambda s, d: V.unresolved(late_imports(s, d), M.manifest(t(s, d, "files"))),
        # graph
        "degrees": lambda s, d: G.degrees(file_nodes(s, d), file_edges(s, d)),
        "neighbors": lambda s, d: G.neighbors(file_nodes(s, d), file_edges(s, d)).select("node", F.array_join("dependents", ",").alias("dependents"), F.array_join("dependencies", ",").alias("dependencies")),
        "neighbor_heads": lambda s, d: G.neighbors(file_nodes(s, d), file_edges(s, d), 2).select("node", F.array_join("dependents", ",").alias("dependents"), "more_dependents"),
        "hubs": lambda s, d: G.hubs(trade_nodes(s, d), trade(s, d)),
        "entry_points": lambda s, d: G.entry_points(file_nodes(s, d), file_edges(s, d)),
        "isolated": lambda s, d: G.isolated(file_nodes(s, d), file_edges(s, d)),
        "change_impact": lambda s, d: G.change_impact(trade_nodes(s, d), trade(s, d)).select("node", "in_degree", F.array_join("dependents", ",").alias("dependents"), "more"),
        "node_style": lambda s, d: G.node_style(G.degrees(trade_nodes(s, d), trade(s, d)), G.circular_nodes(trade_nodes(s, d), trade(s, d))),
        "circular_nodes": lambda s, d: G.circular_nodes(trade_nodes(s, d), trade(s, d)),
        "components": lambda s, d: G.components(trade_nodes(s, d), trade(s, d)),
        "cycles": lambda s, d: G.cycles(trade_nodes(s, d), trade(s, d)).select(F.array_join("nodes", ",").alias("nodes"), "length"),
        "pagerank": lambda s, d: G.pagerank(trade_nodes(s, d), trade(s, d)).select("node", F.round("pagerank", 4).alias("pagerank")),
        "pagerank_rounds": lambda s, d: G.pagerank_rounds(trade_nodes(s, d), trade(s, d), ROUNDS),
        "reading_order": lambda s, d: G.reading_order(file_nodes(s, d), file_edges(s, d)),
        "transitive_impact": lambda s, d: G.transitive_impact(file_edges(s, d)),
        "sampled_subset": lambda s, d: G.sampled(M.manifest(t(s, d, "files")).select(F.col("file_id").alias("node"), S.path_depth(F.col("path")).alias("depth")), file_edges(s, d), Y.file_counts(t(s, d, "symbols")).select(F.col("file_id").alias("node"), "n_symbols"), file_nodes(s, d).select("node", F.lit(0.0).alias("pagerank"))).select("node", "in_degree", "n_symbols"),
        "graph_summary": lambda s, d: sinks.graph_json(trade_nodes(s, d), trade(s, d)).select("n_nodes", "n_edges", "n_circular"),
        # the costly graph operators over all files
        "file_hubs": lambda s, d: G.hubs(file_nodes(s, d), file_links(s, d)),
        "file_change_impact": lambda s, d: G.change_impact(file_nodes(s, d), file_links(s, d)).select("node", "in_degree", F.array_join("dependents", ",").alias("dependents"), "more"),
        "file_node_style": lambda s, d: G.node_style(G.degrees(file_nodes(s, d), file_links(s, d)), G.circular_nodes(file_nodes(s, d), file_links(s, d))),
        "file_circular_nodes": lambda s, d: G.circular_nodes(file_nodes(s, d), file_links(s, d)),
        "file_components": lambda s, d: G.components(file_nodes(s, d), file_links(s, d)),
        "file_cycles": lambda s, d: G.cycles(file_nodes(s, d), file_links(s, d)).select(F.array_join("nodes", ",").alias("nodes"), "length", "complete"),
        "file_pagerank": lambda s, d: G.pagerank(file_nodes(s, d), file_links(s, d)),
        "file_pagerank_rounds": lambda s, d: G.pagerank_rounds(file_nodes(s, d), file_links(s, d), ROUNDS),
        "file_graph_summary": lambda s, d: sinks.graph_json(file_nodes(s, d), file_links(s, d)).select("n_nodes", "n_edges", "n_circular"),
        # scores
        "function_scores": lambda s, d: function_rows(s, d).select("file_id", "function", "complexity"),
        "file_complexity": lambda s, d: C.file_complexity(function_rows(s, d)),
        "risk_levels": lambda s, d: scored(s, d).select("file_id", "risk_level", F.size("risk_reasons").alias("n_reasons")),
        "risk_distribution": lambda s, d: C.risk_distribution(scored(s, d)),
        "repo_mean": lambda s, d: C.repo_mean(scored(s, d)),
        "rows_by_risk": lambda s, d: C.by_risk(scored(s, d)).select("repo", "risk_level", F.array_join("paths", ",").alias("paths")),
        "top_functions": lambda s, d: C.top_functions(function_rows(s, d)),
        "complex_functions": lambda s, d: C.complex_functions(function_rows(s, d)).select("file_id", "function", "complexity"),
        "high_risk_table": lambda s, d: C.top_risky(scored(s, d)),
        "critical_table": lambda s, d: C.top_risky(scored(s, d), ("CRITICAL",)),
        "safe_files": lambda s, d: C.safe_files(scored(s, d), node_degrees(s, d)),
        "complexity_json": lambda s, d: sinks.complexity_json(scored(s, d)),
        # chunks, search, context
        "make_code_chunks": lambda s, d: known_chunks(s, d).where("symbol_type <> 'module'").select("file_id", "chunk_id", "line_start", "line_end", F.sha2("content", 256).alias("content_sha")),
        "make_chunks": lambda s, d: K.make_chunks(t(s, d, "contents"), t(s, d, "symbols")).select("chunk_id", "file_id", "symbol_type", "line_start", "line_end", F.sha2("content", 256).alias("content_sha")),
        "chunk_stats": lambda s, d: K.stats(t(s, d, "chunks")),
        "chunk_sentinels": lambda s, d: K.to_sentinels(t(s, d, "chunks").dropDuplicates(["chunk_no"])).select("chunk_no", "complexity", "risk_level"),
        "store_count": lambda s, d: sinks.store_count(t(s, d, "chunks")),
        "vector_topk": lambda s, d: T.nearest_of_many(t(s, d, "embeddings"), t(s, d, "embeddings").where("vec_id % 100 = 0")),
        "vector_topk_filtered": lambda s, d: T.nearest_of_many(t(s, d, "embeddings"), t(s, d, "embeddings").where("vec_id % 100 = 0"), same="label"),
        "embed_documents": lambda s, d: T.embed(t(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.size("embedding").alias("n"), F.sha2(F.array_join(F.transform("embedding", lambda x: F.format_number(x, 5)), ","), 256).alias("digest")),
        "context_budget": lambda s, d: X.budgeted(t(s, d, "chunks")).select("chunk_no", "position", "used", "fate", "kept_chars"),
        "context_text": lambda s, d: X.assembled(t(s, d, "chunks")).select("repo", "file_path", F.length("context").alias("n_chars"), "n_dropped"),
        "explain_selection": lambda s, d: X.selected(scored(s, d), node_degrees(s, d)),
        # cache and jobs
        "cache_key": lambda s, d: H.keyed(cache_rows(s, d)[0]).select("file_id", "cache_key"),
        "cache_lookup": lambda s, d: H.lookup(*cache_rows(s, d)).select("file_id", "explanation"),
        "cache_misses": lambda s, d: H.misses(*cache_rows(s, d)).select("file_id"),
        "cache_stats": lambda s, d: H.stats(cache_rows(s, d)[1]),
        "duplicate_content": lambda s, d: t(s, d, "files").where("sha IS NOT NULL").groupBy("sha").agg(F.count_distinct("file_id").alias("n"), F.min("file_id").alias("first_file")).where("n > 1"),
        "job_latest": lambda s, d: J.latest(t(s, d, "job_events")).select("job_id", "repo", "status", "current_phase", "progress", "error"),
        "job_phases": lambda s, d: J.phases(t(s, d, "job_events")).select("job_id", F.array_join("phases", ",").alias("phases")),
        "job_agents": lambda s, d: J.phase_status(t(s, d, "job_events")),
        "job_progress": lambda s, d: J.progress_bar(t(s, d, "job_events")),
        "active_jobs": lambda s, d: J.active_per_repo(t(s, d, "job_events")),
        "job_list": lambda s, d: J.listed(t(s, d, "job_events")).select("repo", "position", "job_id", "status"),
        "phase_seconds": lambda s, d: J.phase_seconds(t(s, d, "job_events")),
        # reports
        "architecture_map": lambda s, d: R.architecture(scored(s, d), node_degrees(s, d)),
        "domain_classes": lambda s, d: R.domain_classes(Y.classes(t(s, d, "symbols")), node_degrees(s, d)),
        "file_table": lambda s, d: R.filtered(scored(s, d), "HIGH", "INDEX", "max").select("repo", "path", "max_complexity"),
        "language_bars": lambda s, d: R.bars(M.manifest(t(s, d, "files")).groupBy("language").agg(F.count("*").alias("n_files")), "n_files"),
        "report_summary": lambda s, d: N.summary(facts(s, d)),
        "report_risk": lambda s, d: facts(s, d).scored.select("file_id", "risk_level", F.size("risk_reasons").alias("n_reasons"), "in_cycle", "coupling"),
        "report_architecture": lambda s, d: N.architecture(facts(s, d)),
        "report_entry_points": lambda s, d: N.entry_points(facts(s, d)),
        "report_core": lambda s, d: N.core(facts(s, d)),
        "report_components": lambda s, d: flat(N.components(facts(s, d)), "uses", "users"),
        "report_relationships": lambda s, d: flat(N.relationships(facts(s, d)), "uses", "users"),
        "report_impact": lambda s, d: flat(N.impact(facts(s, d)), "users"),
        "report_high_risk": lambda s, d: N.high_risk(facts(s, d)),
        "report_critical": lambda s, d: N.critical(facts(s, d)),
        "report_parse_errors": lambda s, d: N.parse_errors(facts(s, d)),
        "report_complex_functions": lambda s, d: N.complex_functions(facts(s, d)),
        "report_cycles": lambda s, d: N.rings(facts(s, d)),
        "report_reading": lambda s, d: N.reading(facts(s, d)),
        "report_domain": lambda s, d: N.domain(facts(s, d)),
        "report_safe": lambda s, d: N.safe(facts(s, d)),
        "report_explained": lambda s, d: flat(N.explained(facts(s, d)), "uses", "users").select("repo", "position", "path", "anchor", "one_line", "risk", "in_degree", "uses", "users", "text"),
        "report_explanations_json": lambda s, d: N.explanations_json(facts(s, d)),
        "report_graph_json": lambda s, d: N.graph_json(facts(s, d)).select("repo", F.get_json_object("json", "$.n_nodes").cast("bigint").alias("n_nodes"), F.get_json_object("json", "$.n_edges").cast("bigint").alias("n_edges"), F.json_array_length(F.get_json_object("json", "$.cycles")).alias("n_cycles")),
        "report_complexity_json": lambda s, d: N.complexity_json(facts(s, d)).select("repo", F.get_json_object("json", "$.mean_complexity").cast("double").alias("mean_complexity"), F.get_json_object("json", "$.risk_distribution.CRITICAL").cast("bigint").alias("critical"), F.get_json_object("json", "$.top_functions[0].function").alias("worst_function")),
        "report_onboarding": lambda s, d: documented(s, d, N.onboarding),
        "report_agent_context": lambda s, d: documented(s, d, N.agent_context),
        "report_file_explanations": lambda s, d: documented(s, d, N.file_explanations),
        "api_result": lambda s, d: api_sizes(N.api_result(facts(s, d))),
        "api_json": lambda s, d: N.api_json(facts(s, d)).select("repo", F.sha2("json", 256).alias("json_sha"), F.length("json").alias("n_chars")),
        # parsing
        "parse_functions": parsed_functions,
        "parse_classes": parsed_classes,
        "parse_imports": parsed_imports,
        "parse_symbols": lambda s, d: P.parse_files(t(s, d, "contents")).select("file_id", "language", F.size("functions").alias("n_functions"), F.size("classes").alias("n_classes"), F.size("imports").alias("n_imports"), "parse_error"),
        "parse_complexity": lambda s, d: P.function_complexity(P.parse_files(t(s, d, "contents"))).select("file_id", "function", "complexity"),
    }
    return q


def chunked_files(s: SparkSession, d: str) -> DataFrame:
    """Files that have chunks, which are those of three languages that parse."""
    return t(s, d, "chunks").select("file_id").distinct()


def known_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks made anew of the files that have chunks; flags of parse errors are stale in part, so they are set by that."""
    symbols = t(s, d, "symbols").join(chunked_files(s, d), "file_id", "left_semi").withColumn("parse_error", F.lit(False))
    return K.make_chunks(t(s, d, "contents"), symbols)


def parsed_functions(s: SparkSession, d: str) -> DataFrame:
    """Functions found by parsing, of the files that have chunks."""
    parsed = P.parse_files(t(s, d, "contents")).join(chunked_files(s, d), "file_id", "left_semi")
    return parsed.select("file_id", F.explode("functions").alias("f")).select("file_id", "f.name", "f.line_start", "f.line_end").distinct()


def parsed_classes(s: SparkSession, d: str) -> DataFrame:
    parsed = P.parse_files(t(s, d, "contents")).join(chunked_files(s, d), "file_id", "left_semi")
    return parsed.select("file_id", F.explode("classes").alias("c")).select("file_id", "c.name", "c.line_start", F.array_join("c.bases", ",").alias("bases"), F.array_join("c.method_names", ",").alias("methods")).distinct()


def parsed_imports(s: SparkSession, d: str) -> DataFrame:
    parsed = P.parse_files(t(s, d, "contents")).join(chunked_files(s, d), "file_id", "left_semi")
    return parsed.select("file_id", F.explode("imports").alias("i")).select("file_id", "i.module", F.array_join("i.names", ",").alias("names"), "i.is_from_import").distinct()


def flat(rows: DataFrame, *arrays: str) -> DataFrame:
    return rows.withColumns({c: F.array_join(c, ",") for c in arrays})


def documented(s: SparkSession, d: str, sections: Callable[[N.Facts], dict]) -> DataFrame:
    f = facts(s, d)
    return N.document(f.repos, sections(f)).select("repo", F.sha2("document", 256).alias("document_sha"), F.length("document").alias("n_chars"))


def api_sizes(rows: DataFrame) -> DataFrame:
    """The figures of a result and how long its lists are."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(f"n_{c}")
    lists = ("top_files", "dependency_rows", "critical_and_high", "complexity_rows", "top_complex_functions", "reading_order", "circular_deps")
    return rows.select("repo", "branch", "files_discovered", "files_analyzed", "mode", "n_functions", "n_classes", "n_edges", "n_cycles", "critical", "high", "medium", "low", *[n(c) for c in lists], F.array_join(F.transform("top_files", lambda x: x["path"]), ",").alias("top_paths"), F.element_at("top_complex_functions", 1)["function"].alias("worst_function"))


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def oracle_sql() -> dict[str, str]:
    ext = "lower(regexp_extract(list_extract(string_split(path, '/'), -1), '^.+(\\.[^.]+)$', 1))"
    lang = "CASE " + " ".join(f"WHEN {ext} = '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " ELSE 'Unknown' END"
    parts = "string_split(path, '/')"
    base = f"list_extract({parts}, -1)"
    man = f"""man AS (SELECT DISTINCT ON (file_id) file_id, repo, path, {lang} AS language, size_bytes, sha FROM files WHERE path IS NOT NULL
        AND NOT list_has_any({parts}[:-2], [{', '.join(f"'{x}'" for x in EXCLUDED_DIRS)}]) AND len(list_filter({parts}[:-2], lambda x: ends_with(x, '.egg-info'))) = 0
        AND {base} NOT IN {_list(EXCLUDED_NAMES)} AND {ext} IN {_list(LANGUAGES)} AND coalesce(size_bytes, 0) <= {MAX_FILE_BYTES})"""
    depth = f"len({parts}) - 1"
    sym = "sym AS (SELECT DISTINCT ON (file_id) * FROM symbols)"
    fedges = f"""{man}, fe AS (SELECT DISTINCT a.file_id AS src, b.file_id AS dst FROM man a JOIN man b ON (b.file_id = a.file_id // 2 OR b.file_id = a.file_id // 3) AND a.file_id <> b.file_id),
        deg AS (SELECT file_id AS node, (SELECT count(*) FROM fe WHERE dst = file_id) AS in_degree, (SELECT count(*) FROM fe WHERE src = file_id) AS out_degree FROM man)"""
    trade_ = """g AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
        tr AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rev DESC, dst) AS n FROM g) WHERE n <= 2),
        nd AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation),
        tdeg AS (SELECT node, (SELECT count(*) FROM tr WHERE dst = node) AS in_degree, (SELECT count(*) FROM tr WHERE src = node) AS out_degree FROM nd)"""
    reach = f"""{trade_}, reach AS (SELECT src, dst FROM tr UNION SELECT r.src, t.dst FROM reach r JOIN tr t ON r.dst = t.src)"""
    counts = f"""{sym}, cnt AS (SELECT file_id, repo, path, coalesce(len(functions), 0) AS n_functions, coalesce(len(classes), 0) AS n_classes,
        coalesce(list_sum(list_transform(functions, lambda f: CAST(f.line_end - f.line_start + 1 AS DOUBLE))), 0) AS lines, coalesce(len(list_filter(functions, lambda f: coalesce(f.docstring, '') = '')), 0) AS n_undocumented FROM sym),
        fc AS (SELECT *, n_functions + n_classes AS n_symbols, CASE WHEN n_functions > 0 THEN round(lines / n_functions, 1) ELSE 0.0 END AS avg_function_lines, CASE WHEN n_functions > 0 THEN round(n_undocumented / n_functions, 3) ELSE 0.0 END AS undocumented_ratio FROM cnt)"""
    frows = """ch AS (SELECT DISTINCT ON (chunk_no) * FROM chunks), fr AS (SELECT file_id, symbol_name AS function, max(complexity) AS complexity, min(chunk_no) AS ord FROM ch WHERE symbol_type = 'function' AND complexity IS NOT NULL GROUP BY 1, 2)"""
    fcomp = f"""{frows}, cx AS (SELECT file_id, round(avg(complexity), 2) AS avg_complexity, max(complexity) AS max_complexity, arg_max(function, struct_pack(c := complexity, o := -ord)) AS worst_function FROM fr GROUP BY 1)"""
    scored_ = f"""{fedges}, {counts}, {fcomp},
        ln AS (SELECT file_id, max(CASE WHEN content IS NULL THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END) AS n_lines FROM contents GROUP BY 1),
        er AS (SELECT file_id, bool_or(coalesce(parse_error, false)) AS parse_error FROM symbols GROUP BY 1),
        s0 AS (SELECT m.file_id, m.repo, m.path, m.language, coalesce(n_lines, 0) AS n_lines, fc.n_functions, fc.undocumented_ratio, coalesce(avg_complexity, 0) AS a, coalesce(max_complexity, 0) AS m_, coalesce(out_degree, 0) AS coupling, coalesce(parse_error, false) AS pe
            FROM man m JOIN fc USING (file_id) LEFT JOIN ln USING (file_id) LEFT JOIN cx USING (file_id) LEFT JOIN deg ON deg.node = m.file_id LEFT JOIN er USING (file_id)),
        s1 AS (SELECT *, CAST(pe AS INT) + CAST(m_ >= 21 AS INT) AS c_, CAST(m_ >= 11 AS INT) + CAST(a >= 10 AS INT) + CAST(coupling >= 8 AS INT) + CAST(n_functions >= 3 AND undocumented_ratio >= 0.8 AS INT) + CAST(n_lines >= 600 AS INT) AS h_,
            CAST(a >= 6 AS INT) + CAST(coupling >= 4 AS INT) + CAST(n_functions >= 3 AND undocumented_ratio >= 0.6 AS INT) + CAST(n_lines >= 300 AS INT) AS md_ FROM s0),
        sc AS (SELECT *, CASE WHEN c_ > 0 THEN 'CRITICAL' WHEN h_ > 0 THEN 'HIGH' WHEN md_ > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN c_ > 0 THEN c_ WHEN h_ > 0 THEN h_ ELSE md_ END AS n_reasons FROM s1)"""
    ev = "ev AS (SELECT DISTINCT job_id, repo, ts, received_at, kind, phase, progress, error FROM job_events WHERE job_id IS NOT NULL)"
    latest_ = f"""{ev}, l0 AS (SELECT job_id, max(repo) AS repo, bool_or(kind = 'error') AS failed, coalesce(max(progress), 0) AS progress, bool_or(kind = 'phase') AS started,
        arg_max(phase, struct_pack(a := ts, b := received_at, c := progress)) FILTER (kind = 'phase') AS current_phase, min(ts) AS created_at, max(nullif(error, '')) FILTER (kind = 'error') AS error FROM ev GROUP BY 1),
        jl AS (SELECT job_id, repo, CASE WHEN failed THEN 'failed' WHEN progress >= 100 THEN 'complete' WHEN started THEN 'running' ELSE 'queued' END AS status, current_phase, progress, created_at, CASE WHEN failed THEN coalesce(error, 'unknown error') END AS error FROM l0)"""
    phases_sql = "[" + ", ".join(f"'{p}'" for p in PHASES) + "]"
    agents = f"""{latest_}, ag AS (SELECT job_id, status, coalesce(list_position({phases_sql}, current_phase), 0) - 1 AS at_, unnest(range(0, {len(PHASES)})) AS i FROM jl),
        st AS (SELECT job_id, {phases_sql}[i + 1] AS phase, CASE WHEN status = 'complete' OR i < at_ THEN 'complete' WHEN i = at_ THEN CASE WHEN status = 'failed' THEN 'failed' ELSE 'running' END ELSE 'queued' END AS state FROM ag)"""
    budget = f"""{frows.split(', fr AS')[0]}, b0 AS (SELECT *, CASE symbol_type WHEN 'module' THEN 0 WHEN 'function' THEN 1 ELSE 2 END AS k, length(coalesce(content, '')) AS n_chars FROM ch),
        b1 AS (SELECT *, CASE WHEN k = 1 THEN coalesce(complexity, 0) ELSE 0 END AS cc FROM b0),
        b2 AS (SELECT *, row_number() OVER w AS position, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM b1 WINDOW w AS (PARTITION BY repo, file_path ORDER BY k, cc DESC, line_start, chunk_no)),
        b3 AS (SELECT *, CASE WHEN used <= {X.BUDGET} THEN 'full' WHEN used - n_chars <= {X.BUDGET} AND {X.BUDGET} - (used - n_chars) > {X.LEAST_REST} THEN 'cut' ELSE 'dropped' END AS fate FROM b2)"""
    imp = "im AS (SELECT file_id, repo, path, CAST(generate_subscripts(imports, 1) - 1 AS INT) AS ord, unnest(imports) AS i FROM (SELECT DISTINCT ON (file_id) * FROM symbols))"
    cachekey = f"""{man}, rp AS (SELECT DISTINCT repo, owner, repo_name FROM repos), cf AS (SELECT m.*, CASE WHEN coalesce(sha, '') <> '' THEN sha256(owner || '::' || repo_name || '::' || path || '::' || sha) END AS cache_key FROM man m JOIN rp USING (repo))"""
    knn = lambda extra: f"""WITH e AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS dist FROM e q JOIN e ON q.vec_id <> e.vec_id {extra} WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank, round(dist, 6) AS distance FROM r WHERE rank <= 5"""  # noqa: E731
    ranks = [f"{trade_}, dg AS (SELECT src, count(*) AS k FROM tr GROUP BY 1), nn AS (SELECT count(*) AS n FROM nd), pr0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS r FROM nd, nn)"]
    for i in range(ROUNDS):
        ranks.append(f"pr{i + 1} AS MATERIALIZED (SELECT nd.node, 0.85 * (coalesce((SELECT sum(p.r / dg.k) FROM tr JOIN pr{i} p ON p.node = tr.src JOIN dg ON dg.src = tr.src WHERE tr.dst = nd.node), 0) + (SELECT coalesce(sum(r), 0) FROM pr{i} WHERE node NOT IN (SELECT src FROM tr)) / nn.n) + 0.15 / nn.n AS r FROM nd, nn)")
    flinks = f"""{fedges}, fl AS (SELECT src, dst FROM fe UNION SELECT a.file_id, b.file_id FROM man b JOIN man a ON a.file_id = CASE WHEN b.file_id % 32 = 7 THEN b.file_id // 2 WHEN b.file_id % 64 = 13 THEN b.file_id // 4 END),
        flin AS (SELECT dst AS node, count(*) AS in_degree FROM fl GROUP BY 1), flout AS (SELECT src AS node, count(*) AS out_degree FROM fl GROUP BY 1),
        fh AS (SELECT node, in_degree, coalesce(out_degree, 0) AS out_degree FROM flin LEFT JOIN flout USING (node))"""
    first = lambda n: f"SELECT doc_id, sha256(array_to_string(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31))[:{n}], ' ')) AS sentence_sha FROM documents WHERE text IS NOT NULL"
    o = {
        "repo_url_parts": r"SELECT DISTINCT repo, CASE WHEN len(p) >= 3 THEN p[2] END AS owner, CASE WHEN len(p) >= 3 THEN p[3] END AS name FROM (SELECT repo, string_split(regexp_replace(regexp_replace(regexp_replace(trim(repo_url), '/+$', ''), '\.git$', ''), '^https?://', ''), '/') AS p FROM repos)",
        "basename": f"SELECT DISTINCT file_id, {base} AS base FROM files",
        "short_path": f"SELECT DISTINCT file_id, array_to_string({parts}[greatest(len({parts}) - 2, 1):], '/') AS short FROM files",
        "path_depth": f"SELECT DISTINCT file_id, {depth} AS depth FROM files",
        "path_parent": f"SELECT DISTINCT file_id, array_to_string({parts}[:-2], '/') AS parent FROM files",
        "path_normalize": f"SELECT DISTINCT file_id, array_to_string(list_concat({parts}[:-3], [{base}]), '/') AS target FROM files",
        "anchor_slug": "SELECT DISTINCT file_id, 'exp-' || translate(lower(path), '/._', '---') AS slug FROM files",
        "collection_name": "SELECT DISTINCT repo, 'sediment_' || substr(regexp_replace(repo, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 63 - 9 - 6) || '_job-7' AS collection FROM repos",
        "chunk_ids": "SELECT DISTINCT chunk_no, translate(file_path, '/.-', '___') || '::' || CASE WHEN symbol_type = 'module' THEN 'module' ELSE translate(symbol_name, '. ', '__') END || '::' || line_start || '::' || symbol_type AS chunk_id FROM chunks",
        "manifest_filter": f"WITH {man} SELECT file_id, repo, path, language FROM man",
        "line_counts": f"WITH {man}, ln AS (SELECT file_id, max(CASE WHEN content IS NULL THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END) AS n FROM contents GROUP BY 1) SELECT file_id, coalesce(n, 0) AS n_lines FROM man LEFT JOIN ln USING (file_id)",
        "language_breakdown": f"WITH {man} SELECT repo, language, count(*) AS n_files FROM man GROUP BY 1, 2",
        "code_languages": f"WITH {man} SELECT repo, language, count(*) AS n_files FROM man WHERE language NOT IN ('Markdown', 'YAML', 'TOML', 'Unknown') GROUP BY 1, 2",
        "primary_language": f"WITH {man}, c AS (SELECT repo, language, count(*) AS n FROM man GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY repo) AS total, row_number() OVER (PARTITION BY repo ORDER BY n DESC, language) AS k FROM c) SELECT repo, language, round(100.0::DOUBLE * n / total, 1) AS percent FROM r WHERE k = 1",
        "analysis_tier": f"WITH {man}, n AS (SELECT repo, count(*) AS n FROM man GROUP BY 1) SELECT repo, n AS files_discovered, least(n, {CAP.sampled}) AS files_analyzed, CASE WHEN n <= {CAP.full} THEN 'Full' WHEN n <= {CAP.warning} THEN 'Full (Warning)' ELSE 'Sampled' END AS tier, n <= {CAP.sampled} AS admitted FROM n",
        "manifest_cap": f"WITH {man}, r AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY {depth}, path) AS position FROM man) SELECT repo, position, path FROM r WHERE position <= {CAP.sampled}",
        "symbol_totals": f"WITH {sym} SELECT repo, count(*) AS n_files, CAST(coalesce(sum(len(functions)), 0) AS BIGINT) AS n_functions, CAST(coalesce(sum(len(classes)), 0) AS BIGINT) AS n_classes, CAST(coalesce(sum(len(list_filter(imports, lambda i: i.is_internal))), 0) AS BIGINT) AS n_internal_imports, CAST(coalesce(sum(len(list_filter(functions, lambda f: coalesce(f.docstring, '') = ''))), 0) AS BIGINT) AS n_undocumented, count(*) FILTER (coalesce(parse_error, false)) AS n_parse_errors FROM sym GROUP BY 1",
        "symbol_counts": f"WITH {counts} SELECT file_id, n_functions, n_classes, n_symbols, avg_function_lines, n_undocumented, undocumented_ratio FROM fc",
        "undocumented_functions": f"WITH {sym}, f AS (SELECT file_id, CAST(generate_subscripts(functions, 1) - 1 AS INT) AS ord, unnest(functions) AS f FROM sym) SELECT file_id, ord, f.name AS name FROM f WHERE coalesce(f.docstring, '') = ''",
        "class_table": f"WITH {sym}, f AS (SELECT file_id, CAST(generate_subscripts(classes, 1) - 1 AS INT) AS ord, unnest(classes) AS f FROM sym) SELECT file_id, ord, f.name AS name, len(f.method_names) AS n_methods FROM f",
        "import_table": f"WITH {imp} SELECT file_id, ord, i.module AS module, array_to_string(i.names, ',') AS names, i.is_internal AS is_internal FROM im",
        "degrees": f"WITH {fedges} SELECT node, in_degree, out_degree FROM deg",
        "neighbors": f"WITH {fedges} SELECT node, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM fe WHERE dst = node), '') AS dependents, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM fe WHERE src = node), '') AS dependencies FROM deg",
        "neighbor_heads": f"WITH {fedges}, l AS (SELECT node, coalesce((SELECT list(src ORDER BY src) FROM fe WHERE dst = node), []) AS l FROM deg) SELECT node, array_to_string(l[:2], ',') AS dependents, greatest(len(l) - 2, 0) AS more_dependents FROM l",
        "hubs": f"WITH {trade_} SELECT * FROM tdeg WHERE in_degree > 0 ORDER BY in_degree DESC, node LIMIT 15",
        "entry_points": f"WITH {fedges} SELECT * FROM deg WHERE in_degree = 0 AND out_degree > 0 ORDER BY out_degree DESC, node LIMIT 10",
        "isolated": f"WITH {fedges} SELECT node FROM deg WHERE in_degree = 0 AND out_degree = 0",
        "change_impact": f"WITH {trade_}, h AS (SELECT * FROM tdeg WHERE in_degree > 0 ORDER BY in_degree DESC, node LIMIT 8), l AS (SELECT node, in_degree, (SELECT list(src ORDER BY src) FROM tr WHERE dst = node) AS l FROM h) SELECT node, in_degree, array_to_string(l[:7], ',') AS dependents, greatest(len(l) - 7, 0) AS more FROM l",
        "node_style": f"WITH RECURSIVE {reach}, ci AS (SELECT DISTINCT src AS node FROM reach WHERE src = dst) SELECT node, CASE WHEN node IN (SELECT node FROM ci) THEN 'red' WHEN in_degree >= 6 THEN 'orange' WHEN in_degree >= 3 THEN 'yellow' WHEN in_degree >= 1 THEN 'green' ELSE 'blue' END AS color, least(45, 12 + 4 * in_degree) AS size FROM tdeg",
        "circular_nodes": f"WITH RECURSIVE {reach} SELECT DISTINCT src AS node FROM reach WHERE src = dst",
        "components": f"WITH RECURSIVE {reach} SELECT node, least(node, coalesce((SELECT min(r.dst) FROM reach r JOIN reach s ON r.src = node AND s.src = r.dst AND s.dst = node), node)) AS component FROM nd",
        "cycles": f"WITH RECURSIVE {trade_}, p AS (SELECT src AS s, dst AS e, [src] AS l FROM tr WHERE dst > src UNION ALL SELECT p.s, tr.dst, list_append(p.l, p.e) FROM p JOIN tr ON tr.src = p.e WHERE p.e <> p.s AND (tr.dst = p.s OR (tr.dst > p.s AND NOT list_contains(p.l, tr.dst) AND tr.dst <> p.e))) SELECT array_to_string(l, ',') AS nodes, len(l) AS length FROM p WHERE e = s",
        "pagerank_rounds": "WITH " + ", ".join(ranks) + f" SELECT node, round(r, 6) AS pagerank FROM pr{ROUNDS}",
        "reading_order": f"WITH RECURSIVE {fedges}, lv AS (SELECT node, 0 AS level FROM deg WHERE in_degree = 0 UNION SELECT fe.dst, lv.level + 1 FROM lv JOIN fe ON fe.src = lv.node), mx AS (SELECT node, max(level) AS level FROM lv GROUP BY 1) SELECT row_number() OVER (ORDER BY level DESC, node) AS position, node, level FROM mx",
        "transitive_impact": f"WITH RECURSIVE {fedges}, r AS (SELECT dst AS node, src AS u FROM fe UNION SELECT r.node, fe.src FROM r JOIN fe ON fe.dst = r.u) SELECT node, count(*) AS impacted FROM r GROUP BY 1",
        "sampled_subset": f"WITH {fedges}, {counts} SELECT node, in_degree, coalesce(n_symbols, 0) AS n_symbols FROM (SELECT d.node, d.in_degree, fc.n_symbols, len(string_split(m.path, '/')) - 1 AS depth FROM deg d JOIN man m ON m.file_id = d.node LEFT JOIN fc ON fc.file_id = d.node) ORDER BY in_degree DESC, coalesce(n_symbols, 0) DESC, depth, node LIMIT 300",
        "graph_summary": f"WITH RECURSIVE {reach} SELECT (SELECT count(*) FROM nd) AS n_nodes, (SELECT count(*) FROM tr) AS n_edges, (SELECT count(DISTINCT src) FROM reach WHERE src = dst) AS n_circular",
        "file_hubs": f"WITH {flinks} SELECT * FROM fh ORDER BY in_degree DESC, node LIMIT 15",
        "file_change_impact": f"WITH {flinks}, h AS (SELECT * FROM fh ORDER BY in_degree DESC, node LIMIT 8), l AS (SELECT h.node, in_degree, list(src ORDER BY src) AS l FROM h JOIN fl ON dst = h.node GROUP BY 1, 2) SELECT node, in_degree, array_to_string(l[:7], ',') AS dependents, greatest(len(l) - 7, 0) AS more FROM l",
        "function_scores": f"WITH {frows} SELECT file_id, function, complexity FROM fr",
        "file_complexity": f"WITH {fcomp} SELECT * FROM cx",
        "risk_levels": f"WITH {scored_} SELECT file_id, risk_level, n_reasons FROM sc",
        "risk_distribution": f"WITH {scored_} SELECT repo, l.risk_level, count(*) FILTER (sc.risk_level = l.risk_level) AS n_files FROM sc, (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS risk_level) l GROUP BY 1, 2",
        "repo_mean": f"WITH {scored_} SELECT repo, round(coalesce(sum(CASE WHEN a > 0 THEN CAST(round(a * 100) AS BIGINT) END)::DOUBLE / count(*) FILTER (a > 0), 0) / 100, 2) AS mean_complexity FROM sc GROUP BY 1",
        "rows_by_risk": f"WITH {scored_} SELECT repo, risk_level, string_agg(path, ',' ORDER BY m_ DESC, path, file_id) AS paths FROM sc GROUP BY 1, 2",
        "top_functions": f"WITH {frows} SELECT file_id, function, complexity FROM fr ORDER BY complexity DESC, file_id, ord, function LIMIT 10",
        "complex_functions": f"WITH {frows} SELECT file_id, function, complexity FROM fr WHERE complexity >= 10",
        "high_risk_table": f"WITH {scored_} SELECT repo, path, risk_level, m_ AS max_complexity FROM sc WHERE risk_level IN ('CRITICAL', 'HIGH') ORDER BY risk_level, m_ DESC, repo, path LIMIT 15",
        "critical_table": f"WITH {scored_} SELECT repo, path, risk_level, m_ AS max_complexity FROM sc WHERE risk_level = 'CRITICAL' ORDER BY m_ DESC, repo, path LIMIT 15",
        "safe_files": f"WITH {scored_} SELECT repo, path, in_degree, out_degree FROM sc JOIN deg ON deg.node = sc.file_id WHERE risk_level = 'LOW' AND NOT pe ORDER BY in_degree, out_degree, repo, path LIMIT 10",
        "chunk_stats": "WITH c AS (SELECT DISTINCT repo, chunk_id, symbol_type, language FROM chunks) SELECT symbol_type, language, count(*) AS n_chunks FROM c GROUP BY GROUPING SETS ((symbol_type, language), (symbol_type), (language), ())",
        "chunk_sentinels": "SELECT DISTINCT chunk_no, coalesce(complexity, -1.0) AS complexity, coalesce(risk_level, 'UNKNOWN') AS risk_level FROM chunks",
        "store_count": "SELECT repo, count(DISTINCT chunk_id) AS n_chunks FROM chunks GROUP BY 1",
        "vector_topk": knn(""),
        "vector_topk_filtered": knn("AND q.label = e.label"),
        "context_budget": f"WITH {budget} SELECT chunk_no, position, CAST(used AS BIGINT) AS used, fate, CASE fate WHEN 'full' THEN n_chars WHEN 'cut' THEN {X.BUDGET} - (used - n_chars) ELSE 0 END AS kept_chars FROM b3",
        "explain_selection": f"WITH {scored_}, x AS (SELECT repo, path, risk_level, coalesce(in_degree, 0) AS in_degree, CASE WHEN risk_level = 'CRITICAL' THEN 0 WHEN in_degree >= 5 THEN 1 WHEN risk_level = 'HIGH' THEN 2 WHEN in_degree >= 2 THEN 3 WHEN risk_level = 'MEDIUM' THEN 4 ELSE 5 END AS tier FROM sc LEFT JOIN deg ON deg.node = sc.file_id), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tier, in_degree DESC, path) AS position FROM x) SELECT repo, position, path, tier, in_degree, risk_level FROM r WHERE position <= 20",
        "cache_key": f"WITH {cachekey} SELECT file_id, cache_key FROM cf",
        "cache_lookup": f"WITH {cachekey} SELECT a.file_id, b.x AS explanation FROM cf a LEFT JOIN (SELECT cache_key, 'about ' || path AS x FROM cf WHERE language = 'Python') b ON a.cache_key = b.cache_key",
        "cache_misses": f"WITH {cachekey} SELECT file_id FROM cf WHERE NOT (language = 'Python' AND cache_key IS NOT NULL)",
        "cache_stats": f"WITH {cachekey} SELECT count(*) AS entries, round(coalesce(sum(strlen('about ' || path)), 0) / 1024, 1) AS kilobytes FROM cf WHERE language = 'Python' AND cache_key IS NOT NULL",
        "duplicate_content": "SELECT sha, count(DISTINCT file_id) AS n, min(file_id) AS first_file FROM files WHERE sha IS NOT NULL GROUP BY 1 HAVING count(DISTINCT file_id) > 1",
        "job_latest": f"WITH {latest_} SELECT job_id, repo, status, current_phase, progress, error FROM jl",
        "job_phases": f"WITH {ev}, f AS (SELECT job_id, phase, min(ts) AS ts, min(progress) AS p FROM ev WHERE kind = 'phase' AND phase IS NOT NULL GROUP BY 1, 2) SELECT job_id, string_agg(phase, ',' ORDER BY ts, p, phase) AS phases FROM f GROUP BY 1",
        "job_agents": f"WITH {agents} SELECT job_id, phase, state FROM st",
        "job_progress": f"WITH {agents} SELECT job_id, CAST(round((count(*) FILTER (state = 'complete') + 0.5 * count(*) FILTER (state = 'running')) / {len(PHASES)} * 100) AS INT) AS percent FROM st GROUP BY 1",
        "active_jobs": f"WITH {latest_} SELECT repo, count(*) AS n_active FROM jl WHERE status IN ('queued', 'running') AND repo IS NOT NULL GROUP BY 1",
        "job_list": f"WITH {latest_} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, job_id) AS position, job_id, status FROM jl",
        "phase_seconds": f"WITH {ev}, n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, received_at, kind, progress) AS nx FROM ev) SELECT phase, count(*) AS n, round(avg(epoch_us(nx) - epoch_us(ts)) / 1e6, 3) AS mean_seconds FROM n WHERE kind = 'phase' AND nx IS NOT NULL GROUP BY 1",
        "architecture_map": f"WITH {scored_} SELECT sc.repo, array_to_string(string_split(sc.path, '/')[greatest(len(string_split(sc.path, '/')) - 2, 1):], '/') AS file, in_degree, out_degree, coalesce(risk_level, 'LOW') AS risk_level FROM deg LEFT JOIN sc ON deg.node = sc.file_id WHERE in_degree > 0 ORDER BY in_degree DESC, sc.repo NULLS FIRST, sc.path NULLS FIRST LIMIT 15",
        "domain_classes": f"WITH {fedges}, {sym}, c AS (SELECT file_id, repo, path, generate_subscripts(classes, 1) AS ord, unnest(classes) AS c FROM sym) SELECT c.repo, c.path, c.c.name AS name, len(c.c.method_names) AS n_methods, coalesce(in_degree, 0) AS in_degree FROM c LEFT JOIN deg ON deg.node = c.file_id ORDER BY coalesce(in_degree, 0) DESC, repo, path, ord LIMIT 15",
        "file_table": f"WITH {scored_} SELECT repo, path, m_ AS max_complexity FROM sc WHERE risk_level = 'HIGH' AND contains(lower(path), 'index')",
        "language_bars": f"WITH {man}, c AS (SELECT language, count(*) AS n_files FROM man GROUP BY 1) SELECT language, n_files, CAST(round(100.0 * n_files / (SELECT max(n_files) FROM c)) AS INT) AS percent FROM c",
        "first_sentence": first(1),
        "first_two_sentences": first(2),
        "make_chunks": None,
    }
    o["import_internal"] = f"""WITH {imp}, x AS (SELECT file_id, repo, ord, i.module AS m, {lang} AS language FROM im), fs AS (SELECT DISTINCT repo, path AS f FROM files),
        g AS (SELECT DISTINCT repo, language, m FROM x), r AS (SELECT *, CASE
            WHEN language = 'Python' THEN starts_with(m, '.') OR EXISTS (SELECT 1 FROM fs, (SELECT replace(trim(unnest(string_split(m, ','))), '.', '/') AS p) WHERE fs.repo = g.repo AND (f = p || '.py' OR f = p || '/__init__.py'))
            WHEN language IN ('JavaScript', 'TypeScript') THEN starts_with(m, './') OR starts_with(m, '../')
            WHEN language = 'Rust' THEN starts_with(m, 'crate::') OR starts_with(m, 'super::') OR starts_with(m, 'self::')
            WHEN language = 'Go' THEN contains(string_split(m, '/')[1], '.') AND EXISTS (SELECT 1 FROM fs WHERE fs.repo = g.repo AND (contains(f, m) OR starts_with(f, string_split(m, '/')[-1])))
            WHEN language = 'Java' THEN EXISTS (SELECT 1 FROM fs WHERE fs.repo = g.repo AND starts_with(f, replace(m, '.', '/')))
            WHEN language IN ('C', 'C++') THEN NOT starts_with(m, '<') ELSE false END AS internal FROM g)
        SELECT file_id, ord, coalesce(internal, false) AS internal FROM x LEFT JOIN r ON r.repo = x.repo AND r.m = x.m AND r.language IS NOT DISTINCT FROM x.language"""
    # resolved imports of paths, and reports on their graph
    ends = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    ies = f"""{man}, rk AS (SELECT file_id, repo, path, regexp_replace(path, '\\.[A-Za-z]+$', '') AS stem, CASE WHEN regexp_matches(path, '\\.py$') THEN 'Python' WHEN regexp_matches(path, '\\.(js|jsx|mjs|cjs|ts|tsx)$') THEN 'TypeScript' END AS fam FROM man),
        rn AS (SELECT *, row_number() OVER (PARTITION BY repo, fam ORDER BY path) AS r FROM rk WHERE fam IS NOT NULL),
        pim AS (SELECT DISTINCT a.file_id, a.repo, a.path, a.fam, CASE a.fam WHEN 'Python' THEN replace(b.stem, '.', '/') ELSE b.stem END AS stem FROM rn a JOIN rn b ON a.repo = b.repo AND a.fam = b.fam AND (a.r >= 2 AND b.r = a.r // 2 OR b.r % 5 = 4 AND a.r = b.r // 2)),
        cand AS (SELECT *, CASE fam WHEN 'Python' THEN {ends(V.PY_ENDINGS)} ELSE {ends(V.JS_ENDINGS)} END AS es FROM pim), opt AS (SELECT file_id, repo, stem, k, stem || es[k] AS target FROM cand, range(1, {len(V.JS_ENDINGS) + 1}) x(k) WHERE k <= len(es)),
        hit AS (SELECT o.file_id AS src, o.stem, arg_min(m.file_id, k) AS dst FROM opt o JOIN man m ON m.repo = o.repo AND m.path = o.target GROUP BY 1, 2), fe AS (SELECT DISTINCT src, dst FROM hit WHERE src <> dst),
        din AS (SELECT dst AS node, count(*) AS n FROM fe GROUP BY 1), dout AS (SELECT src AS node, count(*) AS n FROM fe GROUP BY 1),
        deg AS (SELECT file_id AS node, coalesce(din.n, 0) AS in_degree, coalesce(dout.n, 0) AS out_degree FROM man LEFT JOIN din ON din.node = file_id LEFT JOIN dout ON dout.node = file_id)"""
    cyc = f"{ies}, ir AS (SELECT src, dst FROM fe UNION SELECT r.src, fe.dst FROM ir r JOIN fe ON r.dst = fe.src), cyc AS (SELECT DISTINCT src AS node FROM ir WHERE src = dst)"
    isc = scored_.replace(fedges, cyc).replace("coalesce(parse_error, false) AS pe", "coalesce(parse_error, false) AS pe, cyc.node IS NOT NULL AS cy").replace("LEFT JOIN er USING (file_id)", "LEFT JOIN er USING (file_id) LEFT JOIN cyc ON cyc.node = m.file_id").replace("CAST(pe AS INT) + ", "CAST(pe AS INT) + CAST(cy AS INT) + ")
    two = lambda c: f"array_to_string(string_split({c}, '/')[greatest(len(string_split({c}, '/')) - 2, 1):], '/')"
    said = lambda n: f"array_to_string(string_split(regexp_replace(regexp_replace(explanation, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31))[:{n}], ' ')"
    rf = f"""{isc}, fs AS (SELECT m.file_id, m.repo, m.path, {two('m.path')} AS short, in_degree, out_degree, sc.risk_level, sc.a AS avg_complexity FROM man m JOIN deg ON deg.node = m.file_id LEFT JOIN sc ON sc.file_id = m.file_id),
        us AS (SELECT fe.src AS file_id, list(short ORDER BY path) AS uses FROM fe JOIN fs ON fs.file_id = fe.dst GROUP BY 1), ub AS (SELECT fe.dst AS file_id, list(short ORDER BY path) AS users FROM fe JOIN fs ON fs.file_id = fe.src GROUP BY 1),
        od0 AS (SELECT node, 0 AS level FROM deg JOIN man ON file_id = node WHERE in_degree = 0 AND repo NOT IN (SELECT repo FROM cyc JOIN man ON file_id = node) UNION SELECT fe.dst, od0.level + 1 FROM od0 JOIN fe ON fe.src = od0.node), od AS (SELECT node, max(level) AS level FROM od0 GROUP BY 1),
        ex AS (SELECT file_id, max(module_docstring) AS explanation FROM symbols WHERE module_docstring IS NOT NULL GROUP BY 1),
        pair AS (SELECT x.repo, x.short || ' -> ' || y.short || ' -> ' || x.short AS chain, x.file_id || ',' || y.file_id AS key FROM fe a JOIN fe b ON a.src = b.dst AND a.dst = b.src AND a.src < a.dst JOIN fs x ON x.file_id = a.src JOIN fs y ON y.file_id = a.dst)"""
    go = lambda rows, order, k, cols: f"WITH RECURSIVE {rf}, z AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {order}) AS position FROM ({rows})) SELECT repo, position, {cols} FROM z WHERE position <= {k}"
    head = lambda c, n: f"coalesce(array_to_string({c}[:{n}], ','), '') AS {c}"
    near = "SELECT fs.*, uses, users, coalesce(risk_level, '?') AS risk FROM fs LEFT JOIN us USING (file_id) LEFT JOIN ub USING (file_id)"
    lim = Limits()
    figures = f"""WITH RECURSIVE {rf}, {sym.replace('sym AS', 'sy2 AS')}, n1 AS (SELECT repo, count(*) AS n FROM man GROUP BY 1), l1 AS (SELECT repo, language, count(*) AS n FROM man WHERE language NOT IN ('Markdown', 'YAML', 'TOML', 'Unknown') GROUP BY 1, 2),
        l2 AS (SELECT repo, (list(language ORDER BY n DESC, language))[1] AS primary_language, (list(n ORDER BY n DESC, language))[1] AS pn, array_to_string((list(language || ' (' || n || ' files)' ORDER BY n DESC, language))[:5], ', ') AS languages FROM l1 GROUP BY 1),
        t1 AS (SELECT repo, coalesce(sum(len(functions)), 0) AS nf, coalesce(sum(len(classes)), 0) AS nc FROM sy2 GROUP BY 1), e1 AS (SELECT repo, count(*) AS n FROM fe JOIN man ON file_id = src GROUP BY 1), c1 AS (SELECT repo, count(*) AS n FROM pair GROUP BY 1),
        r1 AS (SELECT repo, count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low, count(*) AS ns FROM sc GROUP BY 1),
        fig AS (SELECT n1.repo, n1.n AS files_discovered, least(n1.n, {lim.sampled}) AS files_analyzed, CASE WHEN n1.n <= {lim.full} THEN 'Full' WHEN n1.n <= {lim.warning} THEN 'Full (Warning)' ELSE 'Sampled' END AS mode, primary_language, CAST(round(100.0 * pn / greatest(least(n1.n, {lim.sampled}), 1)) AS INT) AS primary_percent, languages,
        CAST(coalesce(nf, 0) AS BIGINT) AS n_functions, CAST(coalesce(nc, 0) AS BIGINT) AS n_classes, n1.n AS n_nodes, coalesce(e1.n, 0) AS n_edges, coalesce(c1.n, 0) AS n_cycles, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(ns, 0) AS ns
        FROM n1 LEFT JOIN l2 USING (repo) LEFT JOIN t1 USING (repo) LEFT JOIN e1 USING (repo) LEFT JOIN c1 USING (repo) LEFT JOIN r1 USING (repo))"""
    o |= {
        "import_edges": f"WITH {ies} SELECT a.repo, a.path AS src, b.path AS dst FROM fe JOIN man a ON a.file_id = src JOIN man b ON b.file_id = dst",
        "import_degrees": f"WITH {ies} SELECT * FROM deg",
        "import_circular": f"WITH RECURSIVE {cyc} SELECT node FROM cyc",
        "import_isolated": f"WITH {ies} SELECT node FROM deg WHERE in_degree = 0 AND out_degree = 0",
        "report_risk": f"WITH RECURSIVE {isc} SELECT file_id, risk_level, n_reasons, cy AS in_cycle, coupling FROM sc",
        "report_summary": figures + " SELECT * EXCLUDE (ns) FROM fig",
        "report_architecture": go("SELECT *, coalesce(risk_level, 'LOW') AS risk FROM fs", "in_degree DESC, path", 15, "path, in_degree, risk"),
        "report_core": go("SELECT *, coalesce(risk_level, '?') AS risk FROM fs WHERE in_degree > 0", "in_degree DESC, path", 10, "path, in_degree, risk, avg_complexity"),
        "report_relationships": go(f"{near} WHERE in_degree > 0", "in_degree DESC, path", 6, f"path, in_degree, {head('uses', 6)}, {head('users', 6)}, greatest(coalesce(len(users), 0) - 6, 0) AS more_users"),
        "report_impact": go(f"{near} WHERE in_degree > 0", "in_degree DESC, path", 8, f"path, risk, in_degree, {head('users', 7)}, greatest(coalesce(len(users), 0) - 7, 0) AS more_users"),
        "report_high_risk": go("SELECT sc.repo, sc.path, sc.risk_level, m_ AS max_complexity, coupling, coalesce(in_degree, 0) AS in_degree FROM sc LEFT JOIN deg ON node = file_id WHERE risk_level IN ('CRITICAL', 'HIGH')", "risk_level, max_complexity DESC, path", 15, "path, risk_level, max_complexity, coupling, in_degree"),
        "report_critical": go("SELECT *, m_ AS max_complexity, a AS avg_complexity, array_to_string(list_filter([CASE WHEN pe THEN 'does not parse' END, CASE WHEN cy THEN 'in a cycle' END, CASE WHEN m_ >= 21 THEN 'complexity ' || CAST(m_ AS INT) END], lambda x: x IS NOT NULL), ', ') AS notes FROM sc WHERE risk_level = 'CRITICAL'", "max_complexity DESC, path", 15, "path, max_complexity, avg_complexity, coupling, notes"),
        "report_parse_errors": go("SELECT repo, path FROM sc WHERE pe", "path", 10, "path"),
        "report_complex_functions": go("SELECT fs.repo, fs.path, function, complexity, ord FROM fr JOIN fs USING (file_id) WHERE complexity >= 10", "complexity DESC, path, ord, function", 20, "path, function, complexity"),
        "report_cycles": go("SELECT *, greatest(count(*) OVER (PARTITION BY repo) - 10, 0) AS more FROM pair", "chain, key", 10, "chain, 2 AS length, more"),
        "report_reading": go("SELECT fs.repo, fs.path, level, coalesce(risk_level, 'LOW') AS risk, greatest(count(*) OVER (PARTITION BY fs.repo) - 25, 0) AS more FROM od JOIN fs ON file_id = node", "level DESC, path", 25, "path, risk, more"),
        "report_safe": go("SELECT sc.repo, sc.path, a AS avg_complexity, coupling, in_degree, out_degree FROM sc JOIN deg ON node = file_id WHERE risk_level = 'LOW' AND NOT pe", "in_degree, out_degree, path", 10, "path, avg_complexity, coupling, in_degree"),
        "report_domain": go("SELECT c.file_id, c.repo, c.path, i AS ord, classes[i].name AS name, len(classes[i].method_names) AS n_methods, coalesce(in_degree, 0) AS in_degree FROM (SELECT *, unnest(range(1, len(classes) + 1)) AS i FROM (SELECT DISTINCT ON (file_id) * FROM symbols)) c LEFT JOIN deg ON node = c.file_id", "in_degree DESC, path, ord", 15, "path, name, n_methods, in_degree"),
        "report_components": f"""WITH RECURSIVE {rf}, y AS (SELECT x.*, explanation, row_number() OVER (PARTITION BY repo ORDER BY in_degree DESC, path) AS byu FROM ({near}) x LEFT JOIN ex USING (file_id)),
            z AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY explanation IS NULL, in_degree DESC, path) AS position FROM y WHERE explanation IS NOT NULL OR byu <= 15 AND in_degree > 0) SELECT repo, position, path, risk, in_degree, avg_complexity, {head('uses', 6)}, {head('users', 6)}, {said(2)} AS teaser FROM z""",
        "report_explained": go(f"SELECT x.*, explanation, coalesce(risk_level, 'LOW') AS lv FROM ({near}) x JOIN ex USING (file_id)", "in_degree DESC, path", 2**31, f"path, 'exp-' || translate(lower(short), '/._', '---') AS anchor, {said(1)} AS one_line, lv AS risk, in_degree, {head('uses', 6)}, {head('users', 6)}, CASE WHEN lv IN ('CRITICAL', 'HIGH') THEN trim(explanation) ELSE {said(2)} END AS text"),
        "report_entry_points": f"""WITH RECURSIVE {rf}, x AS (SELECT fs.*, level, coalesce(risk_level, '?') AS risk, CASE WHEN in_degree = 0 AND out_degree > 0 THEN 0 WHEN in_degree = 0 AND level IS NOT NULL THEN 1 WHEN out_degree > 0 THEN 2 END AS kind FROM fs LEFT JOIN od ON node = file_id),
            y AS (SELECT *, min(kind) OVER (PARTITION BY repo) AS best FROM x WHERE kind IS NOT NULL), z AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN kind = 1 THEN -level ELSE -out_degree END, path) AS position FROM y WHERE kind = best OR best = 2 AND out_degree > 0)
            SELECT repo, position, path, out_degree, risk FROM z WHERE position <= 10 AND (kind = 0 OR position <= 5)""",
        "report_graph_json": figures + " SELECT repo, n_nodes, n_edges, CASE WHEN n_cycles > 0 THEN CAST(n_cycles AS INT) END AS n_cycles FROM fig",
        "report_complexity_json": figures + """, rm AS (SELECT repo, round(coalesce(sum(CASE WHEN a > 0 THEN CAST(round(a * 100) AS BIGINT) END)::DOUBLE / count(*) FILTER (a > 0), 0) / 100, 2) AS mean_complexity FROM sc GROUP BY 1),
            f1 AS (SELECT fs.repo, (list(function ORDER BY complexity DESC, path, ord, function))[1] AS worst_function FROM fr JOIN fs USING (file_id) GROUP BY 1) SELECT repo, mean_complexity, critical, worst_function FROM rm JOIN fig USING (repo) LEFT JOIN f1 USING (repo)""",
        "api_result": figures + """, b1 AS (SELECT repo, coalesce(max(default_branch), 'main') AS branch FROM repos GROUP BY 1), p1 AS (SELECT repo, array_to_string((list(path ORDER BY in_degree DESC, path))[:10], ',') AS top_paths FROM fs GROUP BY 1),
            f1 AS (SELECT fs.repo, least(count(*), 10) AS n, (list(function ORDER BY complexity DESC, path, ord, function))[1] AS worst FROM fr JOIN fs USING (file_id) GROUP BY 1), o1 AS (SELECT repo, least(count(*), 10) AS n FROM od JOIN man ON file_id = node GROUP BY 1)
            SELECT fig.repo, branch, files_discovered, files_analyzed, mode, n_functions, n_classes, n_edges, n_cycles, critical, high, medium, low, least(n_nodes, 10) AS n_top_files, least(n_nodes, 10) AS n_dependency_rows, critical + high AS n_critical_and_high, ns AS n_complexity_rows, coalesce(f1.n, 0) AS n_top_complex_functions, coalesce(o1.n, 0) AS n_reading_order, n_cycles AS n_circular_deps, top_paths, worst AS worst_function
            FROM fig LEFT JOIN b1 USING (repo) LEFT JOIN p1 USING (repo) LEFT JOIN f1 USING (repo) LEFT JOIN o1 USING (repo)""",
    }
    known = "ks AS (SELECT DISTINCT ON (file_id) * FROM symbols WHERE file_id IN (SELECT file_id FROM chunks))"
    o |= {
        "make_code_chunks": "SELECT DISTINCT file_id, chunk_id, line_start, line_end, sha256(content) AS content_sha FROM chunks WHERE symbol_type <> 'module'",
        "parse_functions": f"WITH {known}, x AS (SELECT file_id, unnest(functions) AS f FROM ks) SELECT DISTINCT file_id, f.name AS name, f.line_start AS line_start, f.line_end AS line_end FROM x",
        "parse_classes": f"WITH {known}, x AS (SELECT file_id, unnest(classes) AS c FROM ks) SELECT DISTINCT file_id, c.name AS name, c.line_start AS line_start, array_to_string(c.bases, ',') AS bases, array_to_string(c.method_names, ',') AS methods FROM x",
        "parse_imports": f"WITH {known}, x AS (SELECT file_id, unnest(imports) AS i FROM ks) SELECT DISTINCT file_id, i.module AS module, array_to_string(i.names, ',') AS names, i.is_from_import AS is_from_import FROM x",
    }
    cands = f"""{imp}, x AS (SELECT file_id, repo, path, ord, i.module AS m, i.names AS ns, i.is_internal AS inside, {lang} AS language, string_split(path, '/')[:-2] AS here, length(regexp_extract(i.module, '^(\\.*)', 1)) AS dots FROM im),
        y AS (SELECT *, replace(substr(m, dots + 1), '.', '/') AS rest, here[:greatest(len(here) - (dots - 1), 0)] AS up FROM x WHERE language IN ('Python', 'JavaScript', 'TypeScript')),
        z AS (SELECT file_id, ord, repo, unnest(range(0, len(string_split(m, ',')))) AS part, string_split(m, ',') AS ms, NULL AS target0, 0 AS base FROM y WHERE language = 'Python' AND dots = 0
            UNION ALL SELECT file_id, ord, repo, 0, NULL, array_to_string(list_append(up, rest), '/'), 0 FROM y WHERE language = 'Python' AND dots > 0 AND rest <> '' UNION ALL SELECT file_id, ord, repo, 0, NULL, array_to_string(list_append(up[:-2], rest), '/'), {len(V.PY_ENDINGS)} FROM y WHERE language = 'Python' AND dots > 0 AND rest <> ''
            UNION ALL SELECT file_id, ord, repo, unnest(range(0, len(k))), list_transform(k, lambda n: array_to_string(list_append(up, n), '/')), NULL, 0 FROM (SELECT *, list_filter(ns, lambda n: n <> '*') AS k FROM y WHERE language = 'Python' AND dots > 0 AND rest = '')),
        ca AS (SELECT file_id, ord, repo, part, base + e - 1 AS pref, coalesce(target0, CASE WHEN ms[part + 1] LIKE '%/%' THEN ms[part + 1] ELSE replace(trim(ms[part + 1]), '.', '/') END) || {ends(V.PY_ENDINGS)}[e] AS target FROM z, range(1, {len(V.PY_ENDINGS) + 1}) q(e)
            UNION ALL SELECT file_id, ord, repo, 0, e - 1, array_to_string(list_append(here, substr(m, 3)), '/') || {ends(V.JS_ENDINGS)}[e] FROM y, range(1, {len(V.JS_ENDINGS) + 1}) q(e) WHERE language <> 'Python' AND starts_with(m, './'))"""
    o |= {
        "import_candidates": f"WITH {cands} SELECT file_id, ord, CAST(part AS INT) AS part, CAST(pref AS INT) AS pref, target FROM ca",
        "import_edges_given": f"WITH {man}, {cands}, h AS (SELECT file_id, ord, part, ca.repo, arg_min(target, pref) AS target FROM ca JOIN man m USING (file_id) JOIN man t ON t.repo = ca.repo AND t.path = ca.target GROUP BY 1, 2, 3, 4) SELECT DISTINCT h.repo, m.path AS src, target AS dst FROM h JOIN man m USING (file_id) WHERE m.path <> target",
        "import_unresolved": f"WITH {man}, {cands}, h AS (SELECT DISTINCT ca.file_id, ca.ord FROM ca JOIN man t ON t.repo = ca.repo AND t.path = ca.target) SELECT repo, count(*) AS n_unresolved FROM x WHERE inside AND NOT EXISTS (SELECT 1 FROM h WHERE h.file_id = x.file_id AND h.ord = x.ord) GROUP BY 1",
    }
    # graphs of files with cycles, by closure
    fr_ = f"{flinks}, fr0 AS (SELECT src, dst FROM fl UNION SELECT r.src, fl.dst FROM fr0 r JOIN fl ON r.dst = fl.src), fci AS (SELECT DISTINCT src AS node FROM fr0 WHERE src = dst)"
    o |= {
        "file_circular_nodes": f"WITH RECURSIVE {fr_} SELECT node FROM fci",
        "file_graph_summary": f"WITH RECURSIVE {fr_} SELECT (SELECT count(*) FROM man) AS n_nodes, (SELECT count(*) FROM fl) AS n_edges, (SELECT count(*) FROM fci) AS n_circular",
        "file_components": f"WITH RECURSIVE {fr_}, cc AS (SELECT a.src AS node, min(a.dst) AS m FROM fr0 a JOIN fr0 b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) SELECT file_id AS node, least(file_id, coalesce(m, file_id)) AS component FROM man LEFT JOIN cc ON node = file_id",
        "file_node_style": f"WITH RECURSIVE {fr_} SELECT file_id AS node, CASE WHEN file_id IN (SELECT node FROM fci) THEN 'red' WHEN d >= 6 THEN 'orange' WHEN d >= 3 THEN 'yellow' WHEN d >= 1 THEN 'green' ELSE 'blue' END AS color, least(45, 12 + 4 * d) AS size FROM (SELECT file_id, coalesce(in_degree, 0) AS d FROM man LEFT JOIN flin ON flin.node = file_id)",
        "context_text": f"""WITH {budget}, pc AS (SELECT repo, file_path, position, fate, CASE fate WHEN 'full' THEN content WHEN 'cut' THEN substr(content, 1, CAST({X.BUDGET} - (used - n_chars) AS BIGINT)) || '{X.CUT.replace(chr(10), "' || chr(10) || '")}' END AS piece FROM b3),
            g1 AS (SELECT repo, file_path, string_agg(piece, chr(10) || chr(10) ORDER BY position) AS body, count(*) FILTER (fate = 'dropped') AS n_dropped FROM pc GROUP BY 1, 2)
            SELECT repo, file_path, length(coalesce(body, '') || CASE WHEN n_dropped > 0 THEN chr(10) || chr(10) || '# ... ' || n_dropped || ' more chunks are not shown' ELSE '' END) AS n_chars, n_dropped FROM g1""",
    }
    # a converged rank is that of many rounds: one matrix of all moves, applied 120 times
    o["pagerank"] = f"""WITH RECURSIVE {trade_}, dg AS (SELECT src, count(*) AS k FROM tr GROUP BY 1), nn AS (SELECT count(*) AS n FROM nd),
        mv AS (SELECT a.node AS src, b.node AS dst, 0.15 / n + 0.85 * CASE WHEN dg.k IS NULL THEN 1.0 / n WHEN tr.dst IS NOT NULL THEN 1.0 / dg.k ELSE 0 END AS w FROM nd a, nd b, nn LEFT JOIN dg ON dg.src = a.node LEFT JOIN tr ON tr.src = a.node AND tr.dst = b.node),
        pr AS (SELECT 0 AS i, node, CAST(1.0 / n AS DOUBLE) AS r FROM nd, nn UNION ALL SELECT pr.i + 1, mv.dst, sum(pr.r * mv.w) FROM pr JOIN mv ON mv.src = pr.node WHERE pr.i < 120 GROUP BY 1, 2) SELECT node, round(r, 4) AS pagerank FROM pr WHERE i = 120"""
    o.pop("make_chunks")
    return o


def entry(spark: SparkSession, d: str = "/root/testdata/sf0.001") -> DataFrame:
    """Risk of the files of all repositories."""
    return C.risk_distribution(scored(spark, d)).orderBy("repo", "risk_level")


