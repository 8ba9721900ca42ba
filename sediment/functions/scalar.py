"""Column expressions: paths, URLs, keys, text.  All are built-in expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EXCLUDED_DIRS, EXCLUDED_NAMES, LANGUAGES, MAX_FILE_BYTES


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def repo_parts(url: Column) -> Column:
    """Host-independent (owner, name) of a repository URL; null if there are fewer than three parts."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", ""), "^https?://", "")
    parts = F.split(bare, "/")
    return F.when(F.size(parts) >= 3, F.struct(parts[1].alias("owner"), parts[2].alias("name")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, "" if there is none; a leading dot is no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    return F.coalesce(_map(LANGUAGES)[suffix(path)], F.when(path.isNotNull(), F.lit("Unknown")))


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def short_path(path: Column) -> Column:
    return F.substring_index(path, "/", -3)


def included(path: Column, size: Column) -> Column:
    """Whether a file is analysed: directories, name, extension, size; an unknown size does not exclude."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad_dir = F.arrays_overlap(dirs, F.array(*map(F.lit, EXCLUDED_DIRS))) | F.exists(dirs, lambda d: d.endswith(".egg-info"))
    return ~bad_dir & ~basename(path).isin(*EXCLUDED_NAMES) & suffix(path).isin(*LANGUAGES) & (F.coalesce(size, F.lit(0)) <= MAX_FILE_BYTES)


def line_count(content: Column) -> Column:
    """Line ends plus one; 0 where there is no content."""
    return F.coalesce(F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1, F.lit(0))


def normalized(path: Column) -> Column:
    """POSIX path without "." and ".."; ".." at the root is dropped."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def cache_key(owner: Column, repo: Column, path: Column, sha: Column) -> Column:
    return F.sha2(F.concat_ws("::", owner, repo, path, sha), 256)


def chunk_id(path: Column, name: Column, line: Column, kind: Column) -> Column:
    return F.concat_ws("::", F.translate(path, "/.-", "___"), F.translate(name, ". ", "__"), line.cast("string"), kind)


def anchor(path: Column) -> Column:
    return F.concat(F.lit("exp-"), F.translate(F.lower(path), "/._", "---"))


def collection_name(middle: Column, job: Column | None = None) -> Column:
    """3 to 63 of [a-zA-Z0-9_-], the job's part kept whole."""
    clean = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")
    tail = F.concat(F.lit("_"), clean(job)) if job is not None else F.lit("")
    name = F.concat(F.lit("sediment_"), F.substr(clean(middle), F.lit(1), F.lit(63) - 9 - F.length(tail)), tail)
    return F.rpad(F.regexp_replace(name, "^[_-]+|[_-]+$", ""), F.greatest(F.lit(3), F.length(F.regexp_replace(name, "^[_-]+|[_-]+$", ""))), "0")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column, n: int) -> Column:
    """The first n sentences."""
    return F.array_join(F.slice(F.split(stripped(text), r"(?<=[.!?])\s+"), 1, n), " ")


def lines_between(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1 and inclusive, clamped, with outer white space stripped; lines end in a line feed alone."""
    lines = F.split(content, "\r?\n")
    first = F.greatest(start, F.lit(1))
    return stripped(F.array_join(F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0))), "\n"))


def risk_weight(level: Column) -> Column:
    from ..config import RISK_WEIGHT

    return F.coalesce(_map(RISK_WEIGHT)[level], F.lit(0))
