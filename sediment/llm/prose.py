"""What counts as prose: words of a passage without markers, tags, sections, code and identifiers."""

from __future__ import annotations

import re

CJK = re.compile(r"[㐀-鿿豈-﫿]")
#: A word: letters with inner apostrophes, not part of an identifier, a number or a path.
_WORD = re.compile(r"(?<![\w./\\@:#$-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w/\\@(\[=-]|[.:](?=\w))")
_MIXED = re.compile(r"[a-z][A-Z]|[A-Z]{2,}[a-z]")
_TAG = re.compile(r"\s*(?:[@\\](?:param|returns?|throws|exception|type|arg|see|since|author|brief|tparam|retval|deprecated|property|template|link|code)\b|:(?:param|returns?|rtype|raises|type|arg|var|ivar)\b|#\[)")
_SECTION = re.compile(r"\s*(?:#+\s*)?(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Attributes|Examples?|Panics|Errors|Safety)\s*:?\s*$")
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[}\])]|[!=]==?[^=]|:=|=>|->|&&|\|\||\+=|::|^\s*(?:if|for|while|switch|match|elif)\b.*[({:]\s*$|^\s*(?:else|try|finally)\s*[:{]|^\s*(?:import|from|package|use|const|let|var|return|def|class|func|fn|function|raise|throw|pub|static|public|private|#include|#define)\s+[\w.{*(\"'\[]+.*(?:[;({:=]|import\b)|^\s*[\w.\[\]]+\s*=\s*\S|^\s*[\w.]+\([^)]*\)\s*$|^\s*@\w+\s*$|^\s*return\s+\w+\s*$|^\s*with\s+.*\bas\b.*:\s*$|^\s*except\b.*:\s*$"
)
#: Where a statement ends inside a passage: at its sign, a quote of code, an empty line or the end of a sentence.
_END = r";|`|\n[ \t]*(?:\n|\Z)|[.!?](?=\s+[^\W\da-z_]|\s*\Z)|[。！？]"
_SQL = re.compile(rf"\b(?:SELECT\b(?:(?!{_END}).)+?\bFROM|INSERT\s+INTO|UPDATE\s+\S+\s+SET|DELETE\s+FROM|CREATE\s+(?:TABLE|INDEX|VIEW)|ALTER\s+TABLE|DROP\s+TABLE|WITH\s+\w+\s+AS\s*\()(?:(?!{_END}).)*", re.S)
_URL = re.compile(r"\b[a-z][a-z0-9+.-]*://\S+|\bwww\.\S+|\bdata:\S+|\S{60,}")
_ESCAPE = re.compile(r"\\(?:[nrt0abfv'\"\\]|x[\da-fA-F]{2}|u\{?[\da-fA-F]{4,6}\}?)|%[-+0 #]*\d*(?:\.\d+)?[a-zA-Z]|\$?\{[^{}]*\}")


def _kept(lines: list[str]) -> list[bool]:
    """Which lines of a passage are prose: no tag lines, parameter sections or code."""
    out, skip = [], False
    for line in lines:
        if not line.strip():
            skip = False
            out.append(True)
            continue
        if _SECTION.match(line):
            skip = True
            out.append(False)
            continue
        if _TAG.match(line):
            skip = False
            out.append(False)
            continue
        if skip and (line[:1] in " \t" or re.match(r"\s*[-*]?\s*\w+\s*(?:\([^)]*\))?\s*:", line)):
            out.append(False)
            continue
        skip = False
        out.append(not _CODE.search(line))
    return out


def prose_lines(text: str) -> list[str]:
    lines = text.splitlines()
    return [line for line, k in zip(lines, _kept(lines)) if k]


def strip_noise(text: str) -> str:
    """Without SQL statements, URLs, encoded runs, escapes and format fields."""
    return _ESCAPE.sub(" ", _URL.sub(" ", _SQL.sub(" ", text)))


def blanked(text: str) -> str:
    """The text with everything that is no prose replaced by blanks, character by character."""
    lines = text.splitlines(keepends=True)
    text = "".join(line if k else " " * len(line) for line, k in zip(lines, _kept([line.rstrip("\r\n") for line in lines])))
    for noise in (_SQL, _URL, _ESCAPE):
        text = noise.sub(lambda m: " " * len(m[0]), text)
    return text


def words(text: str) -> list[str]:
    """The words of a text that are not identifiers."""
    return [w for w in _WORD.findall(text) if not _MIXED.search(w)]


def amount(text: str) -> tuple[int, int]:
    """Words in letters that are not Chinese, and Chinese characters."""
    return sum(1 for w in words(text) if not CJK.search(w)), len(CJK.findall(text))
