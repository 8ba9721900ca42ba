"""File texts to symbol tables: one pass gives symbols and complexities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PARSEABLE
from ..functions import scalar as S
from . import brace_source, python_source

_FUNCTION = "struct<name:string,params:array<string>,line_start:int,line_end:int,docstring:string,is_async:boolean,is_method:boolean>"
_CLASS = "struct<name:string,bases:array<string>,method_names:array<string>,line_start:int,line_end:int,docstring:string>"
_IMPORT = "struct<module:string,names:array<string>,is_from_import:boolean>"
SCHEMA = f"file_id bigint, repo string, path string, language string, module_docstring string, functions array<{_FUNCTION}>, classes array<{_CLASS}>, imports array<{_IMPORT}>, parse_error boolean, parse_error_detail string, complexity map<string,int>"


_NAMES = pa.list_(pa.string())
_LINES = [("line_start", pa.int32()), ("line_end", pa.int32()), ("docstring", pa.string())]
ARROW = {
    "module_docstring": pa.string(),
    "functions": pa.list_(pa.struct([("name", pa.string()), ("params", _NAMES), *_LINES, ("is_async", pa.bool_()), ("is_method", pa.bool_())])),
    "classes": pa.list_(pa.struct([("name", pa.string()), ("bases", _NAMES), ("method_names", _NAMES), *_LINES])),
    "imports": pa.list_(pa.struct([("module", pa.string()), ("names", _NAMES), ("is_from_import", pa.bool_())])),
    "parse_error": pa.bool_(),
    "parse_error_detail": pa.string(),
    "complexity": pa.map_(pa.string(), pa.int32()),
}


def parse_text(text: str, language: str) -> dict:
    """Symbols of one file; what goes wrong in extraction becomes the file's error."""
    try:
        if language == "Python":
            return python_source.parse(text)
        return brace_source.parse(text, {"C/C++ Header": "C", "C++ Header": "C++"}.get(language, language))
    except Exception as e:  # noqa: BLE001
        return python_source.empty(f"Extraction error: {e}")


def parse_files(contents: DataFrame) -> DataFrame:
    """Symbol tables of all files with content in a language that is parsed; a file delivered twice gives one."""
    rows = contents.select("file_id", "repo", "path", S.language(F.col("path")).alias("language"), "content").where(F.col("content").isNotNull() & F.col("language").isin(*PARSEABLE))
    fields = [c.split()[0] for c in ("module_docstring", "functions", "classes", "imports", "parse_error", "parse_error_detail", "complexity")]

    keys = {"file_id": pa.int64(), "repo": pa.string(), "path": pa.string(), "language": pa.string()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                got = [parse_text(c, lang) for c, lang in zip(b.column("content").to_pylist(), b.column("language").to_pylist())]
                columns = [b.column(k).cast(kind) for k, kind in keys.items()]
                columns += [pa.array([list(g[f].items()) if f == "complexity" else g[f] for g in got], ARROW[f]) for f in fields]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *fields])

    return rows.mapInArrow(run, SCHEMA).dropDuplicates(["file_id"])


def function_complexity(parsed: DataFrame) -> DataFrame:
    """file_id, ord, function, complexity of parsed files."""
    return parsed.select("file_id", F.posexplode(F.map_entries("complexity")).alias("ord", "e")).select("file_id", "ord", F.col("e.key").alias("function"), F.col("e.value").cast("double").alias("complexity"))
