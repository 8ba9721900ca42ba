"""Tokenisers of the bundled grammars, and the layout rules of each language.

A tokeniser is one regular expression with a single group, so a whole file becomes a list
of strings in one call; `Kinds` maps each string to its terminal and remembers it.
"""

from __future__ import annotations

import re
from functools import cache

from .glr import Config, Grammar, Machine, text_of
from .jsx import without_elements

#: Language names, as in the tables, and the grammars that make them up.
LANGUAGES = {
    "Python": ("python",),
    "JavaScript": ("javascript",),
    "TypeScript": ("javascript", "typescript"),
    "Go": ("go",),
    "Java": ("java",),
    "Rust": ("rust",),
    "C": ("c",),
    "C++": ("c", "cpp"),
}

_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_NUM = r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?\w*|\.?\d(?:[eEpP][+-]|'?\w|\.(?!\.))*)"
_ID = r"[^\W\d]\w*"
_BLOCK = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_REST = r"\S"

# JavaScript: a template literal with substitutions, one template deep, and where a regular expression may begin.
_T0 = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`"
_HOLE0 = rf"\{{(?:[^{{}}`'\"]|{_DQ}|{_SQ}|{_T0}|\{{(?:[^{{}}`'\"]|{_DQ}|{_SQ}|{_T0}|\{{[^{{}}]*\}})*\}})*\}}"
_T1 = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\${_HOLE0})*`"
_HOLE1 = rf"\{{(?:[^{{}}`'\"]|{_DQ}|{_SQ}|{_T1}|\{{(?:[^{{}}`'\"]|{_DQ}|{_SQ}|{_T1}|\{{[^{{}}]*\}})*\}})*\}}"
_T2 = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\${_HOLE1})*`"
_RE = r"(?:(?<=[(,=:\[!&|?{;~^>])|(?<=[(,=:\[!&|?{;~^>] )|(?<=\W{2})(?<=\s)|(?<=return )|(?<=typeof )|(?<=case ))/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"

# Python strings; a replacement field may hold strings with the same quotes.
_PFX = r"(?:[rRbBuU]|[bB][rR]|[rR][bB])?"
_HOLE = r"\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\})*\}"
_PY_F = (
    rf'[fF][rR]?"""(?:[^"\\{{]|\\[\s\S]|"(?!"")|\{{\{{|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*"""|[rR][fF]"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""'
    rf"|[fF][rR]?'''(?:[^'\\{{]|\\[\s\S]|'(?!'')|\{{\{{|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*'''|[rR][fF]'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
    rf'|(?:[fF][rR]?|[rR][fF])"(?!"")(?:[^"\\\n{{]|\\[\s\S]|\{{\{{|{_HOLE})*"|(?:[fF][rR]?|[rR][fF])\'(?!\'\')(?:[^\'\\\n{{]|\\[\s\S]|\{{\{{|{_HOLE})*\''
)
_PY_S = (
    rf'{_PFX}"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|{_PFX}\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\''
    rf'|{_PFX}"(?!"")(?:[^"\\\n]|\\[\s\S])*"|{_PFX}""(?!")|{_PFX}\'(?!\'\')(?:[^\'\\\n]|\\[\s\S])*\'|{_PFX}\'\'(?!\')'
)
_PY_NL = r"\n(?:[ \t\f\r]*(?:#[^\n]*)?\n)*(?:[ \t]*#[^\n]*\Z)?[ \t\f]*"

_BRACE_NL = r"\n\s*"
_TOKENS = {
    "Python": rf"(?:\\\r?\n[ \t]*)?({_PY_NL}|#[^\n]*|{_PY_F}|{_PY_S}|{_ID}|{_NUM}|->|:=|\.\.\.|\*\*=|//=|>>=|<<=|!=|[-+*/%&|^@<>=]=|\*\*|//|<<|>>|{_REST})[ \t\f\r]*(?:\\\r?\n[ \t]*)?",
    "JavaScript": rf"({_BRACE_NL}|//[^\n]*|{_BLOCK}|#!?[^\W\d][\w$]*|[^\W\d]?(?<![\w$])[\w$]*[^\W\d$]?[A-Za-z_$][\w$]*|{_ID}|{_NUM}|{_RE}|{_DQ}|{_SQ}|{_T2}|=>|\.\.\.|\?\.(?!\d)|\+\+|--|\*\*=|===|!==|>>>=|>>=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|>=|[-+*/%&|^]=|&&|\|\||\?\?|\*\*|<<|{_REST})[ \t\f\r﻿]*",
    "Go": rf"({_BRACE_NL}|//[^\n]*|{_BLOCK}|{_ID}|{_NUM}|{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'|\.\.\.|:=|<-|&\^=|<<=|>>=|&&|\|\||\+\+|--|==|!=|<=|>=|[-+*/%&|^]=|<<|>>|&\^|{_REST})[ \t\r﻿]*",
    "Java": rf"(//[^\n]*|{_BLOCK}|[^\W\d][\w$]*|{_NUM}|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|{_DQ}|'(?:[^'\\\n]|\\[^\n]+?)'|\.\.\.|->|::|>>>=|>>=|<<=|\+\+|--|==|!=|<=|>=|[-+*/%&|^]=|&&|\|\||<<|{_REST})\s*",
    "Rust": rf"(//[^\n]*|{_BLOCK}|b?r(?P<h>#+)\"[\s\S]*?\"(?P=h)|b?r\"[^\"]*\"|r#[^\W\d]\w*|{_ID}(?![\"'])|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n']+|\\')'|'[^\W\d]\w*|{_ID}|\d(?:[eE][+-]\d|\w|\.(?![.\w])|\.(?=\d))*|\.\.\.|\.\.=|\.\.|<<=|>>=|&&|\|\||->|=>|::|==|!=|<=|>=|[-+*/%&|^]=|<<|{_REST})\s*",
    "C": rf"((?m:^)[ \t]*\#(?:[^\n\\/\"']|\\[\s\S]|{_BLOCK}|//[^\n]*|/|{_DQ}|{_SQ}|[\"'])*|//(?:[^\n\\]|\\[\s\S])*|{_BLOCK}|(?:u8|[LuU])?R\"(?P<d>[^(\s\\]{{0,16}})\([\s\S]*?\)(?P=d)\"|(?:u8|[LuU])?\"(?:[^\"\\\n]|\\[\s\S])*\"|(?:u8|[LuU])?'(?:[^'\\\n]|\\[\s\S])+'|{_ID}|{_NUM}|\.\.\.|->|>>=|<<=|\+\+|--|==|!=|<=|>=|[-+*/%&|^]=|&&|\|\||<<|::|{_REST})[ \t\r\f\v]*\n?\s*",
}
_TOKENS["JavaScript"] = _TOKENS["JavaScript"].replace(r"[^\W\d]?(?<![\w$])[\w$]*[^\W\d$]?[A-Za-z_$][\w$]*", r"(?:[^\W\d]|\$)[\w$]*")
_TOKENS["TypeScript"] = _TOKENS["JavaScript"]
_TOKENS["C++"] = _TOKENS["C"]

#: Operators that share a terminal, by language family.
_SAME = {
    "Python": {"OP": "// % & ^ << >>", "PM": "+ -", "BOOL": "and or", "COMP": "== != < > <= >=", "AOP": "+= -= *= /= //= %= **= >>= <<= &= ^= |= @="},
    "JavaScript": {"BIN": "** / % == != === !== <= >= << ^ && || ??", "PM": "+ -", "INC": "++ --", "UN": "~", "AOP": "+= -= *= /= %= **= >>= >>>= <<= &= ^= |= &&= ||= ??="},
    "Go": {"OP": "/ % == != < <= > >= << >> &^ && ||", "PM": "+ - ^", "INC": "++ --", "AOP": "+= -= *= /= %= &= |= ^= <<= >>= &^="},
    "Java": {"OP": "/ % == != <= >= << ^ && ||", "PM": "+", "INC": "++ --", "AOP": "+= -= *= /= %= &= |= ^= <<= >>= >>>="},
    "Rust": {"OP": "/ % == != <= >= << ^", "AOP": "+= -= *= /= %= &= |= ^= <<= >>=", "RANGE": "..= ..."},
    "C": {"OP": "/ % == != <= >= << ^ | ||", "PM": "+ -", "INC": "++ --", "AOP": "+= -= *= /= %= &= |= ^= <<= >>="},
}
_SAME["TypeScript"], _SAME["C++"] = _SAME["JavaScript"], _SAME["C"]
#: Names of built-in types and qualifiers of C and C++.
_C_TYPES = set("void char short int long float double signed unsigned _Bool bool _Complex wchar_t char8_t char16_t char32_t __int128".split())
_C_QUALS = set("const volatile restrict _Atomic __restrict __volatile__ __const _Noreturn thread_local _Thread_local __inline __inline__ __extension__ auto".split())
_C_ALIAS = {"_Static_assert": "static_assert", "_Alignas": "alignas", "_Alignof": "alignof", "__alignof__": "alignof", "__typeof__": "typeof", "__asm__": "asm", "__attribute": "__attribute__", "struct": "struct"}
#: Words with a reading of their own in a language, which are no names although the grammar has no rule for them.
_RESERVED = {"Java": {"goto", "const", "_"}, "Rust": {"abstract", "become", "do", "final", "macro", "override", "priv", "typeof", "unsized", "virtual"}}


class Kinds(dict):
    """Token text to terminal."""

    LIMIT = 300_000

    def __init__(self, lang: str, terminals: set[str]):
        self.lang, self.terminals = lang, terminals
        self.same = {op: kind for kind, ops in _SAME[lang].items() for op in ops.split()}
        self.holes: Machine | None = None

    def __missing__(self, tok: str) -> str:
        if len(self) > self.LIMIT:
            self.clear()
        kind = self[tok] = self.kind(tok)
        return kind

    def kind(self, tok: str) -> str:
        lang, c = self.lang, tok[0]
        if lang == "Python":
            if c == "\n":
                last = tok[tok.rindex("\n") + 1 :].partition("#")[0].replace("\f", "").expandtabs(8)
                return f"NL{len(last)}"
            if c == "#":
                return "SKIP"
        elif c == "\n":
            return "NL"
        elif tok.startswith(("//", "/*")) and len(tok) > 1 and tok not in self.same:
            return "NL" if "\n" in tok and lang in ("JavaScript", "TypeScript", "Go") else "SKIP"
        if tok in self.same:
            return self.same[tok]
        if c == "#" and lang in ("C", "C++"):
            return "SKIP"
        if c in " \t" and lang in ("C", "C++"):
            return "SKIP"
        if c == "#" and len(tok) > 1:
            return "NL" if tok.startswith("#!") else "ID"
        if c in "\"'`" or (c.isalpha() and tok[-1] in "\"'"):
            return self.string(tok)
        if c.isdigit() or (c == "." and len(tok) > 1 and tok[1].isdigit()):
            return "NUM" if self.number(tok) else "BAD"
        if c == "/" and len(tok) > 1:
            return "RE"
        if c.isalpha() or c in "_$" or not c.isascii():
            return self.word(tok)
        return tok

    def word(self, tok: str) -> str:
        if not (tok[0].isalpha() or tok[0] in "_$" or tok.isidentifier()):
            return "BAD"
        if self.lang in ("C", "C++"):
            tok = _C_ALIAS.get(tok, tok)
            if tok in _C_TYPES:
                return "TYPE"
            if tok in _C_QUALS and not (tok == "auto" and self.lang == "C++"):
                return "const" if tok == "const" and self.lang == "C++" else "QUAL"
        if tok in self.terminals and not tok.isupper():
            return tok
        return "BAD" if tok in _RESERVED.get(self.lang, ()) else "ID"

    def number(self, tok: str) -> bool:
        if self.lang == "Python":
            return bool(re.fullmatch(r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*)?\.?(?:\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?", tok)) and not re.fullmatch(r"0[\d_]*[1-9][\d_]*", tok)
        return bool(re.fullmatch(r"0[xX][\da-fA-F_']+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?(?:[uUlLnzZ]*|[ui](?:8|16|32|64|128|size))|0[bB][01_']+\w*|0[oO][0-7_]+\w*|(?:\d[\d_']*)?\.?(?:\d[\d_']*)?(?:[eE][+-]?\d[\d_]*)?(?:[uUlLnfFdDiIzZ]*|_?[uif](?:8|16|32|64|128|size))", tok))

    def string(self, tok: str) -> str:
        lang = self.lang
        if len(tok) == 1:
            return "BAD"
        if tok[0] == "`":
            return ("TPL" if self.template(tok) else "BAD") if lang != "Go" else "STR"
        if lang == "Python":
            prefix = re.match(r"[A-Za-z]*", tok)[0].lower()
            if "f" in prefix:
                return "FSTR" if self.fields(tok[len(prefix) :]) else "BAD"
            return "BYTES" if "b" in prefix else "STR"
        if tok[-1] != tok[len(re.match(r"[A-Za-z0-9#]*", tok)[0])] if tok[-1] != "#" else False:
            return "LIFE" if lang == "Rust" else "BAD"
        if tok.endswith("'") and lang in ("Go", "Java", "Rust", "C", "C++"):
            return "CHAR"
        return "LIFE" if tok[0] == "'" and lang == "Rust" else "STR"

    def expression(self, text: str) -> bool:
        if self.holes is None:
            self.holes = Machine(grammar(self.lang, "stars" if self.lang == "Python" else "expr"))
        return self.holes.run(self._flat, tokens(self.lang, text)) is None

    def _flat(self, tok: str) -> str:
        kind = self[tok]
        return "SKIP" if kind[:2] == "NL" and kind[2:].isdigit() or kind == "NL" else kind

    def template(self, tok: str) -> bool:
        i = 1
        while (i := tok.find("${", i)) >= 0:
            if tok[i - 1] == "\\":
                i += 2
                continue
            m = _HOLE_JS.match(tok, i + 1)
            if not m or not self.expression(m[0][1:-1]):
                return False
            i = m.end()
        return True

    def fields(self, body: str) -> bool:
        quote = 3 if body[:3] in ('"""', "'''") else 1
        body, i = body[quote:-quote], 0
        while i < len(body):
            if body[i : i + 2] in ("{{", "}}"):
                i += 2
                continue
            if body[i] == "}":
                return False
            if body[i] == "{":
                depth, j, cut = 0, i, None
                while j < len(body):
                    c = body[j]
                    if c in "\"'":
                        j = body.find(c, j + 1)
                        if j < 0:
                            return False
                    elif c in "([{":
                        depth += 1
                    elif c in ")]}":
                        depth -= 1
                        if not depth:
                            break
                    elif depth == 1 and cut is None and (c == ":" or c == "!" and body[j + 1 : j + 2] != "="):
                        cut = j
                    j += 1
                else:
                    return False
                text = body[i + 1 : cut or j].strip()
                if text.endswith("=") and text[-2:-1] not in ("=", "!", "<", ">"):
                    text = text[:-1]
                if not text or not self.expression(text):
                    return False
                i = j
            i += 1
        return True


_HOLE_JS = re.compile(_HOLE1)


class _JavaScript(Machine):
    """Automatic semicolons: before a token that cannot follow, after a line end, before '}' and at the end; and after a line end behind a restricted word."""

    RESTRICTED = frozenset({"return", "break", "continue", "throw", "yield"})

    def begin(self):
        return (False, False)

    def layout(self, c: Config, kind: str) -> Config:
        newline, restricted = c.aux
        if kind == "SKIP":
            return c
        if kind == "NL":
            if restricted:
                stacks = self.shift(c.stacks, "ASI")
                return self.config(stacks or c.stacks, (True, False))
            return self.config(c.stacks, (True, restricted))
        stacks = self.shift(c.stacks, kind)
        if kind == "INC" and newline:
            stacks = frozenset()
        if not stacks and (newline or kind == "}"):
            after = self.shift(c.stacks, "ASI")
            stacks = self.shift(after, kind) if after else after
        return self.config(stacks, (False, kind in self.RESTRICTED))

    def end(self, c: Config) -> bool:
        return self.accepts(c.stacks) or self.accepts(self.shift(c.stacks, "ASI"))


class _Go(Machine):
    """A line end after an operand, a closing bracket or a jump is a semicolon; so may be the place before ')' and '}'."""

    ENDS = frozenset({"ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "INC", ")", "]", "}"})

    def begin(self):
        return False

    def layout(self, c: Config, kind: str) -> Config:
        if kind == "SKIP":
            return c
        if kind == "NL":
            return self.config(self.shift(c.stacks, ";"), False) if c.aux else c
        stacks = self.shift(c.stacks, kind)
        return self.config(stacks, kind in self.ENDS)

    def end(self, c: Config) -> bool:
        return self.accepts(c.stacks) or c.aux and self.accepts(self.shift(c.stacks, ";"))


class _Python(Machine):
    """Indentation: the layout state is the bracket depth, the open indents and, at the start of a line, its width."""

    def begin(self):
        return (0, (0,), 0)

    def layout(self, c: Config, kind: str) -> Config:
        depth, indents, width = c.aux
        stacks = c.stacks
        if kind == "SKIP":
            return c
        if kind[:2] == "NL" and kind[2:].isdigit():
            if depth:
                return c
            if width is None:
                stacks = self.shift(stacks, "NEWLINE")
            return self.config(stacks, (0, indents, int(kind[2:])))
        if width is not None:
            if width > indents[-1]:
                stacks, indents = self.shift(stacks, "INDENT"), (*indents, width)
            while width < indents[-1] and stacks:
                stacks, indents = self.shift(stacks, "DEDENT"), indents[:-1]
            if width != indents[-1]:
                stacks = frozenset()
        if kind in ("(", "[", "{"):
            depth += 1
        elif kind in (")", "]", "}"):
            depth = max(0, depth - 1)
        return self.config(self.shift(stacks, kind), (depth, indents, None))

    def end(self, c: Config) -> bool:
        depth, indents, width = c.aux
        stacks = self.shift(c.stacks, "NEWLINE") if width is None else c.stacks
        for _ in indents[1:]:
            stacks = self.shift(stacks, "DEDENT")
        return not depth and self.accepts(stacks)


_MACHINES = {"Python": _Python, "JavaScript": _JavaScript, "TypeScript": _JavaScript, "Go": _Go}
_STARTS = {"Python": "file", "JavaScript": "program", "TypeScript": "program", "Go": "program", "Java": "unit", "Rust": "crate", "C": "unit", "C++": "unit"}
#: What an expression that stands as a statement or as an arrow's body cannot begin with.
_PLAIN = {"expr_plain": ("expr", ("{", "function", "class")), "assign_plain": ("assign", ("{",))}


@cache
def _pattern(lang: str) -> re.Pattern:
    return re.compile(_TOKENS[lang])


def tokens(lang: str, text: str) -> list[str]:
    found = _pattern(lang).findall(text)
    return [t[0] for t in found] if found and found[0].__class__ is tuple else found


def position(lang: str, text: str, index: int) -> tuple[int, str]:
    """Line and text of the token with this number."""
    for i, m in enumerate(_pattern(lang).finditer(text)):
        if i == index:
            return text.count("\n", 0, m.start(1)) + 1, m[1]
    return text.count("\n") + 1, ""


def grammar(lang: str, start: str) -> Grammar:
    return Grammar("\n".join(map(text_of, LANGUAGES[lang])), start, _PLAIN if lang in ("JavaScript", "TypeScript") else None)


@cache
def parser(lang: str) -> tuple[Machine, Kinds]:
    """One recogniser per language and worker process; its tables fill as files are read."""
    g = grammar(lang, _STARTS[lang])
    return _MACHINES.get(lang, Machine)(g), Kinds(lang, g.terminals)


def first_error(lang: str, text: str, jsx: bool = False) -> tuple[int, str] | None:
    """Line and text of the first token at which the file stops being a prefix of the language; None if it is valid."""
    machine, kinds = parser(lang)
    if jsx and "<" in text and (plain := without_elements(text, _pattern(lang).match)) != text:
        text = plain
    if lang == "Python":
        text = text.lstrip("﻿")
        text = "\n" + text if not text.startswith("\n") else text
    toks = tokens(lang, text)
    if all(kinds[t] in ("SKIP", "NL") or kinds[t][:2] == "NL" for t in toks):
        return None
    at = machine.run(kinds.__getitem__, toks)
    if at is None:
        return None
    line, tok = position(lang, text, at)
    return line - (lang == "Python" and text[:1] == "\n"), tok
