"""Problem 2: functions paired with their documentation.

For each entry of ``symbols.functions`` a recursive pattern of the ``regex`` library, anchored where the function's
comment begins, captures the comment, the annotations, the signature and the balanced body together; strings, characters
and comments are atoms of the recursion, so brackets inside them do not count.  In Python the same is done with the
signature, the docstring literal and the indented body.  Captures whose description is trivial are dropped.

Defined results: null content, null entries, names or lines give nothing; a line outside the file gives nothing; repeated
rows give one result; a file that does not parse (problem 1) gives nothing.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_files, confirmed, over
from .p1_syntax import syntax_error
from .prose import CJK, amount, prose_lines, strip_noise, words

MIN_WORDS = 5
MIN_CHINESE = 10

_ATOMS = r"""
(?(DEFINE)
  (?P<str>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)
  (?P<com>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)
  (?P<round>\((?:[^()\[\]{}"'`/]++|(?&str)|(?&com)|(?&round)|(?&square)|(?&curly)|[/"'`])*+\))
  (?P<square>\[(?:[^()\[\]{}"'`/]++|(?&str)|(?&com)|(?&round)|(?&square)|(?&curly)|[/"'`])*+\])
  (?P<curly>\{(?:[^()\[\]{}"'`/]++|(?&str)|(?&com)|(?&round)|(?&square)|(?&curly)|[/"'`])*+\})
)
"""
_COMMENTED = regex.compile(
    _ATOMS
    + r"""
(?P<comment>(?:[ \t]*//[^\n]*\n)+|[ \t]*/\*(?:[^*]|\*(?!/))*+\*/[ \t\r]*\n)
(?P<notes>(?:[ \t]*(?:@[\w.]+(?&round)?|\#!?(?&square)|\[(?&square)\])[ \t\r]*(?:\n[ \t]*)?)*)
(?P<code>(?P<signature>(?:[^(){}\[\]"'`/;]++|(?&round)|(?&square)|(?&com)|=>|=\s*(?=async|\(|function))++)(?P<body>(?&curly)|;|$)?)
""",
    regex.X | regex.S | regex.V1,
)
_PYTHON = regex.compile(
    r"""
(?(DEFINE)
  (?P<str>[A-Za-z]{0,2}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'))
  (?P<round>[(\[{](?:[^()\[\]{}"'\#]++|\#[^\n]*+|(?&str)|(?&round))*+[)\]}])
)
(?P<indent>[ \t]*)(?P<code>(?P<signature>(?:async[ \t]+)?def[ \t]+\w+\s*(?&round)?(?&round)(?:\s*->(?:[^:()\[\]{}"'\#]++|(?&str)|(?&round))*+)?\s*:)
(?:[ \t\r]*(?:\#[^\n]*)?\n)*[ \t]*(?P<doc>(?:[rRuU]?(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')[ \t]*(?:\\\r?\n[ \t]*)?)+)(?=[ \t\r]*(?:;|\#|\n|\Z))
(?P<body>[^\n]*(?:\n(?:[ \t\r]*(?=\n|\Z)|(?P=indent)[ \t]+[^\n]*))*))
""",
    regex.X | regex.S | regex.V1,
)
_NOTE = regex.compile(r"[ \t]*(?:@[\w.]+|#!?\[|\[\[)")
_MARK = regex.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|///?!?)[ \t]?|[ \t]*\*+/[ \t\r]*$")
_SMALL = frozenset("the a an of and or for to in on with from by is this it function method".split())
#: Openings of placeholders, pointers elsewhere and tool directives.
_TRIVIAL = regex.compile(
    r"^\W*(?:(?:todo|fixme|tbd|xxx|hack|wip)\b|(?:see|refer to|cf\.?|siehe|voir|véase|ver|veja|zobacz|смотри|см\.?)\s|参见|(?:eslint|nolint|noqa|pylint|prettier|jshint|jslint|tslint|istanbul|clang-format|rustfmt|noinspection|pragma|region|endregion|sonar|checkstyle|go:|@ts-|type:\s*ignore|formatter:|coverage:)|(?:description|documentation|docs?) (?:goes|to be added|will be|missing|pending|here)|(?:no|add|missing) (?:description|documentation|docs?)\b|lorem ipsum|same as (?:above|below)|inherit)",
    regex.I,
)


def comment_text(comment: str) -> str:
    return "\n".join(_MARK.sub("", line).rstrip() for line in comment.splitlines())


def descriptive(text: str, name: str) -> bool:
    """Whether a description says something: enough words of prose that do not just repeat the name."""
    lines = prose_lines(text)
    first = next((line for line in lines if line.strip(" \t-=*#_/.")), "")
    body = strip_noise("\n".join(lines))
    if _TRIVIAL.search(first):
        rest = regex.split(r"(?<=[.!?。])\s", body.strip(), maxsplit=1)
        if len(rest) < 2:
            return False
        body = rest[1]
    latin, chinese = amount(body)
    if chinese >= MIN_CHINESE:
        return True
    if latin < MIN_WORDS:
        return False
    own = {w.lower() for w in regex.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)}
    return len({w.lower() for w in words(body) if not CJK.search(w)} - own - _SMALL) >= 2


def capture(language: str, text: str, starts: list[int], name: str, line: int) -> tuple[str, str] | None:
    """Description and code of the function that begins on a line; starts: offsets of the lines."""
    if not 1 <= line < len(starts):
        return None
    if language == "Python":
        m = _PYTHON.match(text, starts[line - 1])
        if not m:
            return None
        try:
            doc = ast.literal_eval("(" + m["doc"].strip().replace("\r\n", "\n") + ")")
        except (SyntaxError, ValueError):
            return None
        return (doc, m["code"]) if isinstance(doc, str) else None
    i = line - 2
    row = lambda k: text[starts[k] : starts[k + 1]].rstrip("\r\n")
    while i >= 0 and _NOTE.match(row(i)):
        i -= 1
    if i < 0:
        return None
    last = row(i).strip()
    if last.startswith("//"):
        while i > 0 and row(i - 1).lstrip().startswith("//"):
            i -= 1
    elif last.endswith("*/"):
        at = text.rfind("/*", 0, starts[i + 1])
        while i > 0 and starts[i] > at:
            i -= 1
        if text[starts[i] : at].strip():
            return None
    else:
        return None
    m = _COMMENTED.match(text, starts[i])
    if not m or not m.start("code") <= starts[line] or m.start("code") < starts[line - 1] and m.start("notes") > starts[line - 1]:
        return None
    return comment_text(m["comment"]), m["code"]


def _pairs(rows: Iterable[tuple], with_code: bool) -> Iterable[tuple]:
    for file_id, language, content, jsx, functions in rows:
        starts = [0]
        while (at := content.find("\n", starts[-1])) >= 0:
            starts.append(at + 1)
        starts.append(len(content) + 1)
        found = {}
        for f in functions:
            if not f or f["name"] is None or f["line_start"] is None or (f["name"], f["line_start"]) in found:
                continue
            got = capture(language, content, starts, f["name"], f["line_start"])
            if got and descriptive(got[0], f["name"]):
                found[f["name"], f["line_start"]] = got
        if found and syntax_error(language, content, jsx) is None:
            for (name, line), (doc, code) in found.items():
                yield (file_id, language, name, line, doc, code) if with_code else (file_id, language, name, line)


def documented(contents: DataFrame, symbols: DataFrame, files: DataFrame, with_code: bool = True) -> DataFrame:
    """file_id, name, line_start and, with_code, description and code, of functions with real documentation."""
    listed = symbols.where("size(functions) > 0").select("file_id", F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["line_start"].cast("bigint").alias("line_start"))).alias("functions"))
    rows = code_files(contents).join(listed.hint("shuffle_hash"), "file_id").select("file_id", "language", "content", "jsx", "functions")
    names = ["file_id", "language", "name", "line_start"] + ["description", "code"] * with_code
    types = [pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.string()] * with_code
    schema = "file_id bigint, language string, name string, line_start bigint" + ", description string, code string" * with_code
    found = over(rows, lambda it: _pairs(it, with_code), schema, names, types)
    return confirmed(found, files).drop("language").dropDuplicates(["file_id", "name", "line_start"])
