"""Elements of JSX and TSX: each is read in full and stands as an array of the expressions inside it.

An element is read recursively (tag, attributes, children, closing tag of the same name) where an expression may begin.  What
replaces it is an array literal of its embedded expressions, line ends kept, so that the grammars of the plain languages
read those expressions and errors keep their lines.  An element that does not close, or closes by another name, is left as
it is, and the grammar stops at it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_OPEN = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?")
_CLOSE = re.compile(r"<\s*/\s*([A-Za-z_$][\w$.:-]*)?\s*>")
_NAME = re.compile(r"[A-Za-z_$][\w$:-]*")
_SPACE = re.compile(r"(?:\s|/\*[\s\S]*?\*/)*")
_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_TEXT = re.compile(r"[^<{}>]*")
_EMPTY = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*(?:\n|$))*")
#: What stands before an expression.
_BEFORE = frozenset("( , = ? : && || ?? => { } [ ; return default ! ...".split()) | {""}

Tokens = Callable[[str, int], re.Match | None]


class _No(Exception):
    pass


class _Reader:
    def __init__(self, text: str, token: Tokens):
        self.text, self.token = text, token

    def lines(self, a: int, b: int) -> str:
        return "\n" * self.text.count("\n", a, b)

    def braces(self, at: int) -> tuple[int, str]:
        """End and replaced inside of a braced expression."""
        end, inside = _plain(self, at + 1, True)
        return end, inside

    def embedded(self, at: int) -> tuple[int, str]:
        end, inside = self.braces(at)
        if _EMPTY.fullmatch(inside):
            return end, "\n" * inside.count("\n")
        spread = re.match(r"\s*\.\.\.", inside)
        return end, f"({inside[spread.end():] if spread else inside}\n)," if "//" in inside else f"({inside[spread.end():] if spread else inside}),"

    def element(self, at: int) -> tuple[int, str]:
        text, out = self.text, []
        m = _OPEN.match(text, at)
        name, i = m[1], m.end()
        while True:
            j = _SPACE.match(text, i).end()
            out.append(self.lines(i, j))
            i = j
            if text.startswith("/>", i) and name:
                return i + 2, "[" + "".join(out) + "]"
            if text.startswith(">", i):
                i += 1
                break
            if not name:
                raise _No
            if text.startswith("{", i):
                i, x = self.embedded(i)
                out.append(x)
                continue
            m = _NAME.match(text, i)
            if not m:
                raise _No
            i = m.end()
            j = _SPACE.match(text, i).end()
            if text.startswith("=", j):
                out.append(self.lines(i, j))
                i = _SPACE.match(text, j + 1).end()
                out.append(self.lines(j, i))
                if m := _STRING.match(text, i):
                    out.append(self.lines(i, m.end()))
                    i = m.end()
                elif text.startswith("{", i):
                    i, x = self.embedded(i)
                    out.append(x)
                elif text.startswith("<", i):
                    i, x = self.element(i)
                    out.append(x + ",")
                else:
                    raise _No
        while True:
            j = _TEXT.match(text, i).end()
            out.append(self.lines(i, j))
            i = j
            if m := _CLOSE.match(text, i):
                if m[1] != name:
                    raise _No
                return m.end(), "[" + "".join(out) + self.lines(i, m.end()) + "]"
            if text.startswith("{", i):
                i, x = self.embedded(i)
                out.append(x)
            elif text.startswith("<", i):
                i, x = self.element(i)
                out.append(x + ",")
            else:
                raise _No


def _plain(r: _Reader, at: int, inside: bool) -> tuple[int, str]:
    """Text from a place on, to the brace that closes it if inside one, with its elements replaced."""
    text, out, depth, before = r.text, [], 0, ""
    while at < len(text):
        m = r.token(text, at)
        if not m:
            out.append(text[at])
            at += 1
            continue
        tok = m[1]
        if tok == "<" and before in _BEFORE and _OPEN.match(text, m.start(1)):
            out.append(text[at : m.start(1)])
            try:
                at, x = r.element(m.start(1))
                out.append(x)
                before = "]"
                continue
            except _No:
                at = m.start(1)
        if inside and tok in ("{", "}"):
            depth += 1 if tok == "{" else -1
            if depth < 0:
                out.append(text[at : m.start(1)])
                return m.end(1), "".join(out)
        out.append(text[at : m.end(1)])
        at = m.end(1)
        if tok.strip() and not tok.startswith(("//", "/*")):
            before = tok
    if inside:
        raise _No
    return at, "".join(out)


def without_elements(text: str, token: Tokens) -> str:
    """The text with every complete element replaced by an array of the expressions in it."""
    try:
        return _plain(_Reader(text, token), 0, False)[1]
    except (_No, RecursionError):
        return text
