"""Imports to files of the same repository, as candidate paths and an equi-join on them.

Every import becomes candidate paths in order of preference; the first that is a file wins.  Candidates and files meet on
(repo, path), so a hot repository spreads over its paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

#: What a JavaScript import may leave out, in order.
JS_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
PY_ENDINGS = (".py", "/__init__.py")


def _join(base: Column, rest: Column) -> Column:
    return F.when(F.length(base) > 0, F.concat(base, F.lit("/"), rest)).otherwise(rest)


def _ended(paths: Column, endings: tuple[str, ...]) -> Column:
    return F.flatten(F.transform(paths, lambda p: F.array(*[F.concat(p, F.lit(e)) for e in endings])))


def is_internal(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with ``internal``, by the rules of each language.

    Go: the first segment has a dot, and a file path holds the module or begins with its last segment; Java: a path begins
    with the module's path.  A path that begins with something is met by an equi-join on the beginnings of the distinct
    directories and names of a repository, character by character.  A path that holds a module of several segments has a
    directory that ends in the module's first one, so it is met by the ends of directories with a dot; modules of one segment
    with a dot are few and are held against the paths of their repository.
    """
    m, lang = F.col("module"), F.col("language")
    last = F.element_at(F.split(m, "/"), -1)
    java = F.replace(m, F.lit("."), F.lit("/"))
    rule = (
        F.when(lang == "Python", m.startswith(".") | F.col("py_hit"))
        .when(lang.isin("JavaScript", "TypeScript"), m.startswith("./") | m.startswith("../"))
        .when(lang == "Rust", m.startswith("crate::") | m.startswith("super::") | m.startswith("self::"))
        .when(lang == "Go", F.element_at(F.split(m, "/"), 1).contains(".") & F.col("prefix_hit"))
        .when(lang == "Java", F.col("prefix_hit"))
        .when(lang.isin("C", "C++"), ~m.startswith("<"))
        .otherwise(False)
    )
    paths = files.select("repo", F.col("path").alias("p")).distinct()
    steps = paths.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("p", "/"))), lambda k: F.struct(F.array_join(F.slice(F.split("p", "/"), 1, k - 1), "/").alias("above"), F.element_at(F.split("p", "/"), k).alias("name")))).alias("s")).select("repo", "s.*").distinct().where("name <> ''")
    prefixes = steps.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: _join(F.col("above"), F.substring(F.col("name"), F.lit(1), k)))).alias("p")).distinct()
    keyed = imports.withColumn("module_key", F.when(lang == "Go", last).when(lang == "Java", java))
    go = imports.where("language = 'Go'").select("file_id", "ord", "repo", "module", F.element_at(F.split(m, "/"), 1).alias("first")).where(F.contains("first", F.lit(".")))
    dirs = paths.withColumn("d", F.explode(F.filter(F.slice(F.split("p", "/"), 1, F.greatest(F.size(F.split("p", "/")) - 1, F.lit(0))), lambda x: x.contains("."))))
    ends = dirs.select("repo", "p", F.explode(F.transform(F.sequence(F.lit(1), F.length("d")), lambda k: F.substring(F.col("d"), k, F.length("d")))).alias("first")).distinct()
    held = go.where(F.contains("module", F.lit("/"))).join(ends, ["repo", "first"]).where(F.contains("p", "module")).select("file_id", "ord")
    single = go.where(~F.contains("module", F.lit("/")))
    held = held.unionByName(single.join(single.select("repo", "module").distinct().join(paths, "repo").where(F.contains("p", "module")).select("repo", "module").distinct(), ["repo", "module"]).select("file_id", "ord"))
    py = imports.where("language = 'Python'").select("file_id", "ord", "repo", F.explode(F.split(m, ",")).alias("one")).select("file_id", "ord", "repo", F.explode(_ended(F.array(F.replace(F.trim("one"), F.lit("."), F.lit("/"))), PY_ENDINGS)).alias("p"))
    py = py.join(paths, ["repo", "p"], "left_semi").select("file_id", "ord").distinct().withColumn("py_hit", F.lit(True))
    pre = keyed.where("module_key IS NOT NULL").select("file_id", "ord", "repo", F.col("module_key").alias("p")).join(prefixes, ["repo", "p"], "left_semi").select("file_id", "ord").unionByName(held).distinct().withColumn("prefix_hit", F.lit(True))
    out = imports.join(py, ["file_id", "ord"], "left").join(pre, ["file_id", "ord"], "left")
    return out.withColumns({"py_hit": F.coalesce("py_hit", F.lit(False)), "prefix_hit": F.coalesce("prefix_hit", F.lit(False))}).withColumn("internal", F.coalesce(rule, F.lit(False))).drop("py_hit", "prefix_hit")


def flagged(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Parsed symbols with ``is_internal`` set in each of their imports; only the imports' places and flags are joined back."""
    one = parsed.select("file_id", "repo", "path", S.language(F.col("path")).alias("language"), F.posexplode("imports").alias("ord", "i")).select("file_id", "repo", "path", "language", "ord", "i.*")
    inside = is_internal(one, files).where("internal").groupBy("file_id").agg(F.collect_set("ord").alias("inside"))
    flag = F.transform("imports", lambda i, k: F.struct(i["module"].alias("module"), i["names"].alias("names"), i["is_from_import"].alias("is_from_import"), F.coalesce(F.array_contains("inside", k), F.lit(False)).alias("is_internal")))
    return parsed.join(inside, "file_id", "left").withColumn("imports", flag).drop("inside")


def candidates(imports: DataFrame) -> DataFrame:
    """file_id, ord, part, pref, repo, path, target: possible files of each import of Python, JavaScript and TypeScript."""
    m = F.col("module")
    dots = F.length(F.regexp_extract(m, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/"))
    here = S.parent(F.col("path"))
    up = F.array_join(F.slice(F.split(here, "/"), 1, F.greatest(F.size(F.split(here, "/")) - (dots - 1), F.lit(0))), "/")
    above = S.parent(up)
    names = F.filter("names", lambda n: n != "*")
    python = (
        F.when(dots == 0, F.transform(F.split(m, ","), lambda x: _ended(F.array(F.replace(F.trim(x), F.lit("."), F.lit("/"))), PY_ENDINGS)))
        .when(F.length(rest) > 0, F.array(_ended(F.array(_join(up, rest), _join(above, rest)), PY_ENDINGS)))
        .otherwise(F.transform(names, lambda n: _ended(F.array(_join(up, n)), PY_ENDINGS)))
    )
    js = F.when(m.startswith("./") | m.startswith("../"), F.array(_ended(F.array(S.normalized(_join(here, m))), JS_ENDINGS)))
    parts = F.when(F.col("language") == "Python", python).when(F.col("language").isin("JavaScript", "TypeScript"), js)
    one = imports.select("file_id", "ord", "repo", "path", F.posexplode(parts).alias("part", "options"))
    return one.select("file_id", "ord", "part", "repo", "path", F.posexplode("options").alias("pref", "target"))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, ord, part, repo, path, target: the first candidate that is a file."""
    known = files.select("repo", F.col("path").alias("target")).distinct()
    hits = candidates(imports).join(known, ["repo", "target"])
    return hits.groupBy("file_id", "ord", "part", "repo", "path").agg(F.min_by("target", "pref").alias("target"))


def edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """repo, src, dst: distinct, without loops."""
    return resolved(imports, files).where("path <> target").select("repo", F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def unresolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Internal imports without a file, per repository."""
    hit = resolved(imports, files).select("file_id", "ord").distinct()
    return imports.where("is_internal").join(hit, ["file_id", "ord"], "left_anti").groupBy("repo").agg(F.count("*").alias("n_unresolved"))
