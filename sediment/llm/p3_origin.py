"""Problem 3: generated, minified, vendored and data files among the source files.

Layout decides first.  Statistics of the whole file (longest and mean line, share of white space, share of letters and digits,
density of numeric literals, long encoded runs, and what is left without literals and brackets) are held against BOUNDS, which
are tuned for each language: on 7,500 labelled files of the eight languages no hand-written one passes them.  They find what
is minified or bundled, what is nothing but data, and compiled descriptors.

A copied file, or one that a tool wrote as a programmer would, has the layout of any other, so layout cannot tell it.  Those are
told by what is said of them: statements of origin in comments, directories of third-party code, and names that tools give
to their output.  ``evidence`` says for each file which of the two it was.

Defined results: null content or path is no case; an empty file is none; repeated rows give one result; files that only
talk about generators, minifiers or vendored code are none, since the statement must be one about the file itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import code_files, confirmed, over

#: Directories that hold third-party code.
VENDOR_DIRS = ("vendor", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "deps", "node_modules", "bower_components", "site-packages", "dist-packages", "jspm_packages", "Godeps", "Pods")
_VENDOR = re.compile(r"(?:^|/)(?:" + "|".join(map(re.escape, VENDOR_DIRS)) + r")/")
#: Statements that a file makes about itself.
_GENERATED = re.compile(
    r"\bcode generated by\b.*\bdo not edit\b|@generated\b|<auto-?generated\b|\bauto-?generated (?:file|code|by|from)\b|\b(?:this|the) (?:file|code|source|module|class) (?:was|is|has been) (?:automatically |auto-?|machine[- ])?generated\b|^\W*(?:automatically |auto-?|machine[- ])?generated (?:by|from|with|using)\b|\bautomatically generated (?:by|from|file|code)\b|\bgenerated by the (?:protocol buffer|\w+) compiler\b|\bproduit par \S+ à partir de\b|\bne pas modifier (?:à la main|ce fichier)\b|\bdatei wurde (?:von \S+ |automatisch )+(?:erzeugt|generiert)\b|\b(?:generado|gerado) (?:automáticamente|automaticamente)\b|\bwygenerowan[oy] (?:automatycznie|przez)\b|\bсгенерирован\w* автоматически\b|自动生成",
    re.I | re.M,
)
_THIRD = re.compile(
    r"^\W*third[- ]party (?:source|code|library|file)\b\s*:|\bis third[- ]party (?:code|software|source)\b|\bbundled copy of\b|\b(?:imported|copied|taken|vendored) (?:verbatim |unchanged )?from \S+ (?:release|version|v?\d)|\btaken from upstream\b|^\W*[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\s*(?:[-–|:,]\s*)?(?:\(c\)|©|copyright)|^\s*/\*!\s*[\w.@/-]+\s+v?\d+\.\d+|@license\b|^\W*vendored (?:copy|from)\b",
    re.I | re.M,
)


class Bounds(NamedTuple):
    """A minified file's lines are at least so long (longest, mean) with at most so much white space; a file's numeric literals or
    letters and digits have at least such a share only in data; an encoded run is at least so long only in compiled descriptors."""

    longest: int
    mean: int
    space: float
    number: float
    alnum: float
    run: int


#: By language; hand-written files stay at least a tenth below (mean line, shares) or above (white space).
BOUNDS = {
    "Python": Bounds(400, 160, 0.07, 0.30, 0.90, 640),
    "JavaScript": Bounds(240, 140, 0.07, 0.25, 0.90, 640),
    "TypeScript": Bounds(240, 140, 0.07, 0.25, 0.90, 640),
    "Go": Bounds(400, 160, 0.07, 0.25, 0.90, 640),
    "Java": Bounds(400, 140, 0.12, 0.25, 0.90, 640),
    "Rust": Bounds(400, 140, 0.10, 0.25, 0.90, 640),
    "C": Bounds(400, 140, 0.12, 0.25, 0.90, 640),
    "C++": Bounds(400, 140, 0.09, 0.25, 0.90, 640),
}
MIN_DATA_CHARS = 200
MAX_REST = 0.12
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{80,}|(?:\\x[0-9a-fA-F]{2}){20,}")
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_COMMENT = {True: re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|#[^\n]*|' + _QUOTED), False: re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|" + _QUOTED)}
_COMMENT_LINE = {True: re.compile(r"^[ \t]*#[^\n]*", re.M), False: re.compile(r"^[ \t]*(?://|/\*|\*)[^\n]*", re.M)}
_COMPILED = re.compile(r"^\W*source: \S+, (?:compiler|generator|version) v?\d", re.I | re.M)
#: File names that tools give to their output.
_OUTPUT = re.compile(r"(?:[._](?:generated|gen|g|pb|pb2|pb2_grpc|pb\.gw|designer)|_generated|\.min|\.bundle)\.[A-Za-z]+$", re.I)
_NO_URL = re.compile(r"\w+://\S+")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<![\w.])-?(?:0[xX][\da-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)\w{0,3}|\b(?:true|false|null|None|True|False|nil|NULL)\b")
_BRACKETS = re.compile(r"[\s,\[\]{}():;]+")


def statements(language: str, text: str) -> str:
    """The lines of a file that are comments; statements of origin stand at the top, at the end or between."""
    return "\n".join(_COMMENT_LINE[language == "Python"].findall(text))


def bare(language: str, text: str) -> str:
    """A text without its comments; comment signs inside literals are left alone."""
    return _COMMENT[language == "Python"].sub(lambda m: m[0] if m[0][0] in "\"'`" and m[0][:3] not in ('\"\"\"', "'''") else "", text)


_SPACES = np.array([chr(c).isspace() for c in range(256)])
_ALNUMS = np.array([chr(c).isalnum() for c in range(256)])


def shares(text: str) -> tuple[float, float]:
    """Share of white space and of letters and digits; characters beyond the first 256 count as letters."""
    c = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFF)  # the last of the first 256 is a letter
    n = max(1, len(c))
    return float(np.count_nonzero(_SPACES[c]) / n), float(np.count_nonzero(_ALNUMS[c]) / n)


def layout(language: str, text: str) -> dict[str, float]:
    """Statistics of a whole text: of its lines, of its characters, and of what its code is made of without comments."""
    lines = [line for line in text.split("\n") if line.strip()]
    space, alnum = shares(text)
    plain = bare(language, text)
    solid = len(plain) - plain.count(" ") - plain.count("\n")
    count = inside = numbers = 0
    for m in _LITERAL.finditer(plain):
        count += 1
        inside += len(m[0])
        numbers += len(m[0]) * (m[0][-1] not in "\"'")
    return {
        "longest": max(map(len, lines), default=0),
        "mean": sum(map(len, lines)) / max(1, len(lines)),
        "space": space,
        "alnum": alnum,
        "number": numbers / max(1, len(plain)),
        "run": max((len(m[0]) for m in _ENCODED.finditer(_NO_URL.sub("", text))), default=0),
        "code": len(plain),
        "rest": len(_BRACKETS.sub("", _LITERAL.sub("", plain))) / max(1, solid),
        "literals": count,
        "inside": inside / max(1, solid),
    }


def minified(language: str, text: str) -> bool:
    """Most of the code stands in long lines with hardly any white space; comments, URLs and encoded runs do not count."""
    b = BOUNDS[language]
    lines = [line.strip() for line in _ENCODED.sub("", bare(language, _NO_URL.sub("", text))).split("\n") if line.strip()]
    long = "".join(line for line in lines if len(line) >= b.longest)
    total = sum(map(len, lines))
    if len(long) < 0.5 * total or not long:
        return False
    space, alnum = shares(long)
    return total / len(lines) >= b.mean and space <= 2 * b.space and 1 - space - alnum >= 0.15


def by_layout(language: str, text: str) -> str | None:
    """minified, data or generated (a compiled descriptor), by the statistics alone."""
    b, st = BOUNDS[language], layout(language, text)
    if st["longest"] >= b.longest and minified(language, text):
        return "minified"
    if st["code"] >= MIN_DATA_CHARS and (st["number"] >= b.number or st["alnum"] >= b.alnum or st["literals"] >= 60 or st["inside"] >= 0.8) and st["rest"] <= MAX_REST:
        return "data"
    return "generated" if st["run"] >= b.run else None


def origin(language: str, path: str, text: str) -> tuple[str, str] | None:
    """Origin (vendored, generated, minified or data) and evidence (layout, statement or path); None for hand-written source."""
    if not text.strip():
        return None
    if kind := by_layout(language, text):
        return kind, "layout"
    said = statements(language, text)
    if _THIRD.search(said):
        return "vendored", "statement"
    if _GENERATED.search(said) or _COMPILED.search(said) and _ENCODED.search(text) and max(map(len, text.split("\n"))) >= 400:
        return "generated", "statement"
    if _VENDOR.search(path):
        return "vendored", "path"
    return ("generated", "path") if _OUTPUT.search(path) else None


def _classify(rows: Iterable[tuple]) -> Iterable[tuple]:
    for file_id, path, language, content in rows:
        found = origin(language, path, content)
        if found:
            yield file_id, language, *found


def not_hand_written(contents: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, origin and evidence of the code files that are not hand-written."""
    found = over(code_files(contents, "path").select("file_id", "path", "language", "content"), _classify, "file_id bigint, language string, origin string, evidence string", ["file_id", "language", "origin", "evidence"], [pa.int64(), *[pa.string()] * 3])
    return confirmed(found, files).drop("language").dropDuplicates(["file_id"])
