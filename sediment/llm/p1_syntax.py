"""Problem 1: source files that do not parse.

Each code file is read in full by the recogniser of its language (``glr``, ``lexers``): bundled grammars, LR tables
that fill on demand, all conflicts kept.  The first token at which no stack survives is the file's first unrecoverable
error.  In files whose path ends in .jsx or .tsx, elements are read too (``jsx``).  Nothing looks at a file a second time.

Defined results: null content is no case; empty files, and files of blanks and comments alone, are valid; repeated rows
give one result; rates count each file once; a language other than the eight is ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_files, confirmed, over
from .lexers import first_error


def syntax_error(language: str, text: str, jsx: bool = False) -> tuple[int, str] | None:
    """Line and token of the first unrecoverable error, or None for a valid file."""
    return first_error(language, text, jsx)


def _scan(rows: Iterable[tuple]) -> Iterable[tuple]:
    for file_id, repo, language, content, jsx in rows:
        error = syntax_error(language, content, jsx)
        yield file_id, repo, language, error is not None, error and error[0], error and error[1][:80]


def scan(contents: DataFrame) -> DataFrame:
    """One row per code file delivered: file_id, repo, language, parse_error, error_line, error_token."""
    return over(
        code_files(contents, "repo"),
        _scan,
        "file_id bigint, repo string, language string, parse_error boolean, error_line int, error_token string",
        ["file_id", "repo", "language", "parse_error", "error_line", "error_token"],
        [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string()],
    )


def invalid_files(contents: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, language, parse_error_detail of files that are not valid in their language."""
    found = scan(contents).where("parse_error").select("file_id", "language", F.format_string("line %d: unexpected %s", "error_line", F.when(F.col("error_token") == "", "end of file").otherwise(F.col("error_token"))).alias("parse_error_detail"))
    return confirmed(found, files).distinct()


def error_rates(contents: DataFrame, files: DataFrame) -> DataFrame:
    """Files, files that do not parse and their share, per repository and language."""
    each = confirmed(scan(contents), files).groupBy("file_id", "repo", "language").agg(F.max("parse_error").alias("bad"))
    return each.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count_if("bad").alias("n_parse_errors"), F.round(F.avg(F.col("bad").cast("double")), 6).alias("parse_error_rate"))
