"""Sections of reports as tables of all repositories at once, and documents made of them.

A section is a table with repo and position; what a report cuts off is cut off per repository, by windows that keep the first
rows only.  A document is one text per repository: each section's rows become lines, lines are joined by position, sections
by their order.  A repository without rows in a section has that section's sentence for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import score as C


class Facts:
    """What reports are made of, each table made when it is first asked for.  All have a column repo unless their key is a file_id.

    repos(repo, repo_url, default_branch), tiers(repo, files_discovered, files_analyzed, tier), languages(repo, language, n_files)
    of code, totals(repo, n_functions, n_classes), scored(file_id, repo, path, risk_level, ..), nodes(file_id, repo, path),
    degrees(file_id, in_degree, out_degree), edges(src, dst) and cycles(nodes, length) of file_ids, order(file_id, level),
    classes(file_id, repo, path, ord, name, method_names), functions(file_id, function, complexity, ord),
    explanations(file_id, explanation).
    """

    NAMES = ("repos", "tiers", "languages", "totals", "scored", "nodes", "degrees", "edges", "cycles", "order", "classes", "functions", "explanations")

    def __init__(self, **makers: Callable[[], DataFrame]):
        if set(makers) != set(self.NAMES):
            raise TypeError(f"facts needed: {', '.join(self.NAMES)}")
        self._makers = makers

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Facts.NAMES:
            raise AttributeError(name)
        table = self._makers[name]()
        setattr(self, name, table)
        return table


def first(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each repository, with their position."""
    w = Window.partitionBy("repo").orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo").agg(F.count("*").alias("n"))


def summary(f: Facts) -> DataFrame:
    """One row of figures per repository; the primary language's share is of the files analysed."""
    risks = f.scored.groupBy("repo").agg(*[F.count_if(F.col("risk_level") == x).alias(x.lower()) for x in C.LEVELS])
    ranked = first(f.languages, 5, F.desc("n_files"), "language").groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("position", "language", "n_files"))).alias("top"))
    nodes = f.nodes.select("file_id", "repo")
    edges = _counted(f.edges.join(nodes.withColumnRenamed("file_id", "src"), "src")).withColumnRenamed("n", "n_edges")
    rings = _counted(f.cycles.select(F.col("nodes")[0].alias("file_id")).join(nodes, "file_id")).withColumnRenamed("n", "n_cycles")
    out = f.tiers.join(f.totals.select("repo", "n_functions", "n_classes"), "repo", "left").join(ranked, "repo", "left").join(risks, "repo", "left").join(_counted(nodes).withColumnRenamed("n", "n_nodes"), "repo", "left").join(edges, "repo", "left").join(rings, "repo", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "repo", "files_discovered", "files_analyzed", F.col("tier").alias("mode"), F.col("top")[0]["language"].alias("primary_language"),
        F.round(100 * F.col("top")[0]["n_files"] / F.greatest("files_analyzed", F.lit(1))).cast("int").alias("primary_percent"),
        F.array_join(F.transform("top", lambda x: F.concat(x["language"], F.lit(" ("), x["n_files"].cast("string"), F.lit(" files)"))), ", ").alias("languages"),
        *[n(c) for c in ("n_functions", "n_classes", "n_nodes", "n_edges", "n_cycles", "critical", "high", "medium", "low")],
    )


def ranked_files(f: Facts, default: str | None) -> DataFrame:
    """Nodes with degrees, and risk and mean complexity where they are scored."""
    return f.nodes.join(f.degrees, "file_id").join(f.scored.select("file_id", "risk_level", "avg_complexity"), "file_id", "left").withColumn("risk", C.risk_or(F.col("risk_level"), default))


def entry_points(f: Facts, k: int = 10, fallback: int = 5) -> DataFrame:
    """Files that nothing imports, by what they import; without any, the first of the reading order that nothing imports; without
    those, the files that import most."""
    rows = ranked_files(f, "?").join(f.order.select("file_id", "level"), "file_id", "left")
    kind = F.when((F.col("in_degree") == 0) & (F.col("out_degree") > 0), 0).when((F.col("in_degree") == 0) & F.col("level").isNotNull(), 1).when(F.col("out_degree") > 0, 2)
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    best = rows.groupBy("repo").agg(F.min("kind").alias("best"))
    rows = rows.join(best, "repo").where((F.col("kind") == F.col("best")) | (F.col("best") == 2) & (F.col("out_degree") > 0))
    out = first(rows, k, F.when(F.col("kind") == 1, -F.col("level")).otherwise(-F.col("out_degree")), "path")
    return out.where((F.col("kind") == 0) | (F.col("position") <= fallback)).select("repo", "position", "path", "out_degree", "risk")


def architecture(f: Facts, k: int = 15) -> DataFrame:
    return first(ranked_files(f, "LOW"), k, F.desc("in_degree"), "path").select("repo", "position", "path", "in_degree", "risk")


def core(f: Facts, k: int = 10) -> DataFrame:
    return first(ranked_files(f, "?").where("in_degree > 0"), k, F.desc("in_degree"), "path").select("repo", "position", "path", "in_degree", "risk", "avg_complexity")


def _links(f: Facts, wanted: DataFrame, head: int) -> DataFrame:
    """The first files that each wanted file imports and is imported by, and how many more of those there are."""
    names = f.nodes.select("file_id", S.short_path(F.col("path")).alias("short"), "path")

    def side(key: str, other: str, name: str) -> DataFrame:
        rows = f.edges.join(wanted.select(F.col("file_id").alias(key)), key, "left_semi").join(names.withColumnRenamed("file_id", other), other)
        w = Window.partitionBy(key).orderBy("path")
        rows = rows.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(key))).where(F.col("k") <= head)
        return rows.groupBy(F.col(key).alias("file_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "short"))), lambda x: x["short"]).alias(name), (F.first("n") - F.count("*")).alias(f"more_{name}"))

    none = F.array().cast("array<string>")
    out = wanted.join(side("src", "dst", "uses"), "file_id", "left").join(side("dst", "src", "users"), "file_id", "left")
    return out.withColumns({"uses": F.coalesce("uses", none), "users": F.coalesce("users", none), "more_uses": F.coalesce("more_uses", F.lit(0)), "more_users": F.coalesce("more_users", F.lit(0))})


def components(f: Facts, k: int = 15, head: int = 6) -> DataFrame:
    """Explained files, then the most imported ones, each once, with their surroundings and the beginning of the explanation."""
    rows = ranked_files(f, "?").join(f.explanations, "file_id", "left")
    w = Window.partitionBy("repo").orderBy(F.desc("in_degree"), "path")
    rows = rows.withColumn("by_users", F.row_number().over(w)).where(F.col("explanation").isNotNull() | (F.col("by_users") <= k) & (F.col("in_degree") > 0))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("explanation").isNull(), F.desc("in_degree"), "path")))
    return _links(f, rows, head).select("repo", "position", "path", "risk", "in_degree", "avg_complexity", "uses", "users", S.sentences(F.col("explanation"), 2).alias("teaser"))


def relationships(f: Facts, k: int = 6, head: int = 6) -> DataFrame:
    rows = first(ranked_files(f, "?").where("in_degree > 0"), k, F.desc("in_degree"), "path")
    return _links(f, rows, head).select("repo", "position", "path", "in_degree", "uses", "users", "more_users")


def impact(f: Facts, k: int = 8, head: int = 7) -> DataFrame:
    """Direct dependents of the most imported files."""
    rows = first(ranked_files(f, "?").where("in_degree > 0"), k, F.desc("in_degree"), "path")
    return _links(f, rows, head).select("repo", "position", "path", "risk", "in_degree", "users", "more_users")


def high_risk(f: Facts, k: int = 15) -> DataFrame:
    rows = f.scored.where("risk_level IN ('CRITICAL', 'HIGH')").join(f.degrees.select("file_id", "in_degree"), "file_id", "left")
    return first(rows, k, "risk_level", F.desc("max_complexity"), "path").select("repo", "position", "path", "risk_level", "max_complexity", "coupling", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def critical(f: Facts, k: int = 15) -> DataFrame:
    note = F.array_compact(F.array(F.when(F.col("parse_error"), "does not parse"), F.when(F.col("in_cycle"), "in a cycle"), F.when(F.col("max_complexity") >= 21, F.format_string("complexity %d", F.col("max_complexity").cast("int")))))
    rows = f.scored.where("risk_level = 'CRITICAL'").withColumn("notes", F.array_join(note, ", "))
    return first(rows, k, F.desc("max_complexity"), "path").select("repo", "position", "path", "max_complexity", "avg_complexity", "coupling", "notes")


def parse_errors(f: Facts, k: int = 10) -> DataFrame:
    return first(f.scored.where("parse_error"), k, "path").select("repo", "position", "path")


def complex_functions(f: Facts, k: int = 20, least: float = 10) -> DataFrame:
    rows = f.functions.where(F.col("complexity") >= least).join(f.nodes, "file_id")
    return first(rows, k, F.desc("complexity"), "path", "ord", "function").select("repo", "position", "path", "function", "complexity")


def rings(f: Facts, k: int = 10) -> DataFrame:
    """The first cycles of each repository and how many more there are; a chain ends where it begins."""
    names = f.nodes.select("file_id", "repo", S.short_path(F.col("path")).alias("short"))
    one = f.cycles.withColumn("id", F.xxhash64("nodes")).select("id", "length", F.array_join("nodes", ",").alias("key"), F.posexplode(F.concat("nodes", F.slice("nodes", 1, 1))).alias("at", "file_id")).join(names, "file_id")
    rows = one.groupBy("repo", "id", "key", "length").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "short"))), lambda x: x["short"]), " -> ").alias("chain"))
    n = _counted(rows)
    return first(rows, k, "length", "chain", "key").join(n, "repo").select("repo", "position", "chain", "length", F.greatest(F.col("n") - k, F.lit(0)).alias("more"))


def reading(f: Facts, k: int = 25) -> DataFrame:
    """The first files of the reading order, and how many more there are."""
    rows = f.order.join(f.nodes, "file_id").join(f.scored.select("file_id", "risk_level"), "file_id", "left")
    return first(rows, k, F.desc("level"), "path").join(_counted(rows), "repo").select("repo", "position", "path", C.risk_or(F.col("risk_level"), "LOW").alias("risk"), F.greatest(F.col("n") - k, F.lit(0)).alias("more"))


def domain(f: Facts, k: int = 15) -> DataFrame:
    rows = f.classes.join(f.degrees.select("file_id", "in_degree"), "file_id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return first(rows, k, F.desc("in_degree"), "path", "ord").select("repo", "position", "path", "name", F.size("method_names").alias("n_methods"), "in_degree")


def safe(f: Facts, k: int = 10) -> DataFrame:
    rows = f.scored.where("risk_level = 'LOW' AND NOT parse_error").join(f.degrees, "file_id", "left").fillna(0, ["in_degree", "out_degree"])
    return first(rows, k, "in_degree", "out_degree", "path").select("repo", "position", "path", "avg_complexity", "coupling", "in_degree")


def explained(f: Facts, k: int | None = None, head: int = 6) -> DataFrame:
    """Explained files by dependents; grave ones with reasons, surroundings and the whole text, others with two sentences."""
    rows = ranked_files(f, "LOW").join(f.explanations.where("explanation IS NOT NULL"), "file_id").join(f.scored.select("file_id", "risk_reasons"), "file_id", "left")
    rows = _links(f, first(rows, k or 2**31 - 1, F.desc("in_degree"), "path"), head)
    grave = F.col("risk").isin("CRITICAL", "HIGH")
    short = S.short_path(F.col("path"))
    return rows.select("repo", "position", "path", S.anchor(short).alias("anchor"), S.sentences(F.col("explanation"), 1).alias("one_line"), "risk", "in_degree", "avg_complexity", F.when(grave, F.array_join("risk_reasons", "; ")).alias("reasons"), "uses", "users", F.when(grave, F.trim("explanation")).otherwise(S.sentences(F.col("explanation"), 2)).alias("text"))


def explanations_json(f: Facts) -> DataFrame:
    """repo, json: explanations by short path; of files with equal short paths the last one stands."""
    deps = f.edges.join(f.nodes.select(F.col("file_id").alias("dst"), S.short_path(F.col("path")).alias("short")), "dst").groupBy(F.col("src").alias("file_id")).agg(F.sort_array(F.collect_list("short")).alias("dependencies"))
    rows = ranked_files(f, "LOW").join(f.explanations.where("explanation IS NOT NULL"), "file_id").join(deps, "file_id", "left").withColumn("short", S.short_path(F.col("path")))
    value = F.struct("explanation", "risk", "in_degree", F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"))
    one = rows.groupBy("repo", "short").agg(F.max_by(value, "path").alias("value"))
    return one.groupBy("repo").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("short", "value"))))).alias("json"))


def _lines(rows: DataFrame, line: Column, *after: Column) -> DataFrame:
    """repo, text: the lines of each repository by position."""
    return rows.groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"), *after)


def _listed(c: str) -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit("none"))


def onboarding(f: Facts) -> dict[str, tuple[DataFrame, str]]:
    """Sections of the document for new readers: rows as lines, and what stands where there are none."""
    s = summary(f).withColumn("position", F.lit(1))
    fmt = F.format_string
    path = S.short_path(F.col("path"))
    figures = fmt("- files: %d of %d, mode %s\n- primary language: %s (%d%%)\n- functions: %d, classes: %d\n- import graph: %d files, %d imports, %d cycles\n- risk: %d critical, %d high, %d medium, %d low", "files_analyzed", "files_discovered", "mode", F.coalesce("primary_language", F.lit("Unknown")), F.coalesce("primary_percent", F.lit(0)), "n_functions", "n_classes", "n_nodes", "n_edges", "n_cycles", "critical", "high", "medium", "low")
    more = lambda what: F.when(F.max("more") > 0, fmt(f"\n(%d more {what})", F.max("more"))).otherwise("")
    with_more = lambda rows, line, what: _lines(rows, line, more(what).alias("rest")).select("repo", F.concat("text", "rest").alias("text"))
    return {
        "Summary": (_lines(s, fmt("%s: languages %s", "repo", "languages")), "Nothing is known."),
        "Figures": (_lines(s, figures), "Nothing was counted."),
        "Architecture": (_lines(architecture(f), fmt("%d. %s: imported by %d, %s", "position", path, "in_degree", "risk")), "No imports within the repository."),
        "Components": (_lines(components(f), fmt("%s (%s, imported by %d)\n  uses: %s\n  used by: %s%s", path, "risk", "in_degree", _listed("uses"), _listed("users"), F.coalesce(F.concat(F.lit("\n  "), "teaser"), F.lit("")))), "None stands out."),
        "Cycles": (with_more(rings(f), fmt("%d. %s", "position", "chain"), "cycles"), "There are none."),
        "Critical files": (_lines(critical(f), fmt("%d. %s: highest complexity %d, coupling %d; %s", "position", path, F.col("max_complexity").cast("int"), F.col("coupling").cast("int"), "notes")), "There are none."),
        "Files that do not parse": (_lines(parse_errors(f), fmt("%d. %s", "position", path)), "There are none."),
        "Complex functions": (_lines(complex_functions(f), fmt("%d. %s in %s: %d", "position", "function", path, F.col("complexity").cast("int"))), "There are none."),
        "Reading order": (with_more(reading(f), fmt("%d. %s (%s)", "position", path, "risk"), "files"), "There is none."),
    }


def agent_context(f: Facts) -> dict[str, tuple[DataFrame, str]]:
    """Sections of the short document for tools that change the repository."""
    fmt, path = F.format_string, S.short_path(F.col("path"))
    s = summary(f).join(f.repos.select("repo", "repo_url", "default_branch"), "repo", "left").withColumn("position", F.lit(1))
    over = fmt("%s, branch %s\n%d of %d files, %s\n%d functions, %d imports among %d files\nrisk: %d critical, %d high, %d medium, %d low", F.coalesce("repo_url", "repo"), F.coalesce("default_branch", F.lit("main")), "files_analyzed", "files_discovered", "languages", "n_functions", "n_edges", "n_nodes", "critical", "high", "medium", "low")
    ring = _lines(rings(f), fmt("- %s", "chain"), F.max("more").alias("more")).select("repo", F.concat("text", F.when(F.col("more") > 0, fmt("\n(%d more cycles)", "more")).otherwise("")).alias("text"))
    return {
        "Overview": (_lines(s, over), "Nothing is known."),
        "Entry points": (_lines(entry_points(f), fmt("- %s: imports %d, %s", path, "out_degree", "risk")), "None was found."),
        "Core": (_lines(core(f), fmt("%d. %s: imported by %d, %s, mean complexity %s", "position", path, "in_degree", "risk", F.coalesce(fmt("%.1f", "avg_complexity"), F.lit("?")))), "No imports within the repository."),
        "Relationships": (_lines(relationships(f), fmt("- %s\n  uses: %s\n  used by: %s%s", path, _listed("uses"), _listed("users"), F.when(F.col("more_users") > 0, fmt(" and %d more", "more_users")).otherwise(""))), "No imports within the repository."),
        "High risk": (_lines(high_risk(f), fmt("- %s: %s, highest complexity %d, coupling %d, imported by %d", path, "risk_level", F.col("max_complexity").cast("int"), F.col("coupling").cast("int"), "in_degree")), "There is none."),
        "Cycles": (ring, "There are none."),
        "Domain objects": (_lines(domain(f), fmt("- %s in %s: %d methods, file imported by %d", "name", path, "n_methods", "in_degree")), "No classes."),
        "Change impact": (_lines(impact(f), fmt("- %s (%s): %s%s", path, "risk", _listed("users"), F.when(F.col("more_users") > 0, fmt(" and %d more", "more_users")).otherwise(""))), "No imports within the repository."),
        "Safe beginnings": (_lines(safe(f), fmt("- %s: mean complexity %.1f, coupling %d, imported by %d", path, "avg_complexity", F.col("coupling").cast("int"), "in_degree")), "No file of low risk."),
        "Explanations": (_lines(explained(f, 15), fmt("- %s (%s, imported by %d): %s", path, "risk", "in_degree", "text")), "No file was explained."),
    }


def file_explanations(f: Facts) -> dict[str, tuple[DataFrame, str]]:
    """An index of one line a file, and the explanations."""
    fmt, path = F.format_string, S.short_path(F.col("path"))
    rows = explained(f)
    detail = fmt("### %s {#%s}\n%s, imported by %d, mean complexity %s%s%s\n%s", path, "anchor", "risk", "in_degree", F.coalesce(fmt("%.1f", "avg_complexity"), F.lit("?")), F.when(F.coalesce("reasons", F.lit("")) != "", F.concat(F.lit("\nReasons: "), "reasons")).otherwise(""), F.when(F.col("risk").isin("CRITICAL", "HIGH"), fmt("\nuses: %s; used by: %s", _listed("uses"), _listed("users"))).otherwise(""), F.coalesce("text", F.lit("")))
    return {"Index": (_lines(rows, fmt("- [%s](#%s): %s (%s)", path, "anchor", F.coalesce("one_line", F.lit("")), "risk")), "No file was explained."), "Files": (_lines(rows, detail), "No file was explained.")}


def document(repos: DataFrame, sections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """repo, document: the sections of each repository one behind the other."""
    every = None
    for i, (title, (rows, empty)) in enumerate(sections.items()):
        one = repos.select("repo").distinct().join(rows.select("repo", "text"), "repo", "left").select("repo", F.lit(i).alias("i"), F.concat(F.lit(f"## {title}\n\n"), F.coalesce("text", F.lit(empty))).alias("part"))
        every = one if every is None else every.unionAll(one)
    return every.groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "\n\n").alias("document"))


def api_result(f: Facts, top: int = 10) -> DataFrame:
    """repo and the parts of the result that a client gets: figures, top lists, explanations; nested, one row a repository.

    Lists of whole repositories (all scored files, the grave ones, cycles) are as long as the repository's analysed files.
    """
    base = F.element_at(F.split("path", "/"), -1)

    def gathered(rows: DataFrame, name: str, *fields: Column | str) -> DataFrame:
        return rows.groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(name))

    files = ranked_files(f, None)
    head = first(files, top, F.desc("in_degree"), "path")
    every = first(f.scored, 2**31 - 1, "path")
    functions = first(f.functions.join(f.nodes, "file_id"), top, F.desc("complexity"), "path", "ord", "function")
    chains = f.cycles.withColumn("id", F.xxhash64("nodes")).select("id", F.posexplode("nodes").alias("at", "file_id")).join(f.nodes, "file_id").groupBy("repo", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("nodes"))
    parts = [
        gathered(head, "top_files", base.alias("file"), "path", "in_degree", "out_degree", "risk"),
        gathered(head, "dependency_rows", base.alias("file"), "path", F.col("in_degree").alias("imported_by"), F.col("out_degree").alias("imports"), C.risk_or(F.col("risk"), "LOW").alias("risk")),
        gathered(every.where("risk_level IN ('CRITICAL', 'HIGH')"), "critical_and_high", "path", "risk_level", "risk_reasons", "avg_complexity", "max_complexity", "worst_function", "coupling", "parse_error", "in_cycle"),
        gathered(every, "complexity_rows", base.alias("file"), "path", F.col("risk_level").alias("risk"), "avg_complexity", "max_complexity", "worst_function", "coupling", F.col("risk_reasons").alias("flags")),
        gathered(functions, "top_complex_functions", "path", "function", "complexity"),
        gathered(reading(f, top), "reading_order", "path").withColumn("reading_order", F.transform("reading_order", lambda x: x["path"])),
        chains.groupBy("repo").agg(F.sort_array(F.collect_list("nodes")).alias("circular_deps")),
        f.languages.groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n_files")))).alias("language_breakdown")),
        f.explanations.where("explanation IS NOT NULL").join(f.nodes, "file_id").groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "explanation")))).alias("explanations")),
    ]
    out = summary(f).join(f.repos.select("repo", F.coalesce("default_branch", F.lit("main")).alias("branch")), "repo", "left")
    for p in parts:
        out = out.join(p, "repo", "left")
    return out


def api_json(f: Facts, job: str = "") -> DataFrame:
    """repo, json: the result as it is sent."""
    r = api_result(f)
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    counts = F.struct("critical", "high", "medium", "low")
    top = F.struct(F.col("files_analyzed").alias("total_files"), "files_discovered", "files_analyzed", F.col("mode").alias("analysis_mode"), "language_breakdown", F.col("n_functions").alias("total_functions"), F.col("n_classes").alias("total_classes"), F.col("n_edges").alias("total_import_edges"), F.col("n_cycles").alias("circular_dep_count"), counts.alias("risk_distribution"), F.greatest(n(F.map_keys("explanations")), F.lit(0)).alias("files_explained"), "top_complex_functions")
    body = F.struct(F.lit(job).alias("job_id"), "repo", "branch", top.alias("summary"), F.struct("critical_and_high", "circular_deps").alias("complexity_report"), F.struct(F.col("top_files").alias("top_files_by_indegree"), (F.greatest(n("reading_order"), F.lit(0)) > 0).alias("topological_order_available"), F.col("reading_order").alias("reading_order_top_10")).alias("graph_summary"), "explanations", "dependency_rows", "reading_order", "complexity_rows", "circular_deps")
    return r.select("repo", F.to_json(body).alias("json"))


def graph_json(f: Facts) -> DataFrame:
    """repo, json: numbers of nodes and edges, cycles, reading order and the degrees of every file."""
    nodes = f.nodes.join(f.degrees, "file_id").groupBy("repo").agg(F.count("*").alias("n_nodes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", F.struct("in_degree", "out_degree"))))).alias("files"))
    edges = _counted(f.edges.join(f.nodes.select(F.col("file_id").alias("src"), "repo"), "src")).withColumnRenamed("n", "n_edges")
    ring = f.cycles.withColumn("id", F.xxhash64("nodes")).select("id", F.posexplode("nodes").alias("at", "file_id")).join(f.nodes, "file_id").groupBy("repo", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("nodes")).groupBy("repo").agg(F.sort_array(F.collect_list("nodes")).alias("cycles"))
    order = f.order.join(f.nodes, "file_id").groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("level")).alias("k"), "path"))), lambda x: x["path"]).alias("order"))
    rows = nodes.join(edges, "repo", "left").join(ring, "repo", "left").join(order, "repo", "left")
    return rows.select("repo", F.to_json(F.struct("n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "cycles", "order", "files")).alias("json"))


def complexity_json(f: Facts, k: int = 10) -> DataFrame:
    """repo, json: files of each risk level, the mean complexity, the most complex functions, and the files by level, the most complex first."""
    dist = C.risk_distribution(f.scored).groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("risk_level", "n_files")))).alias("risk_distribution"))
    top = first(f.functions.join(f.nodes, "file_id"), k, F.desc("complexity"), "path", "ord", "function").groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "path", "function", "complexity"))), lambda x: x.dropFields("position")).alias("top_functions"))
    row = F.struct((-F.col("max_complexity")).alias("o"), "path", "avg_complexity", "max_complexity", "worst_function", "coupling", "risk_reasons")
    by = f.scored.groupBy("repo", "risk_level").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x.dropFields("o")).alias("files")).groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("risk_level", "files")))).alias("by_risk"))
    return dist.join(C.repo_mean(f.scored), "repo").join(top, "repo", "left").join(by, "repo").select("repo", F.to_json(F.struct("risk_distribution", "mean_complexity", "top_functions", "by_risk")).alias("json"))
