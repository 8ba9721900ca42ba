"""Symbols and complexity of languages with braces, from a token list with matched brackets.

Comments and literals are single tokens, so nothing inside them counts.  Declarations are recognised by the tokens before a
body; bodies are found by matching brackets; functions inside functions count toward both.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .python_source import Symbols, empty

_TOKEN = re.compile(
    r"""//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[A-Za-z_$#][\w$]*|\d[\w.]*|=>|->|::|\.\.\.|&&|\|\||\?\?|\?\.|:=|<-|[-+*/%=!<>&|^]=|\S"""
)
#: A template literal with substitutions that may hold braces and plain templates, and a regular expression where an expression begins.
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*\})*`"
_REGEX = r"(?:(?<=[(,=:\[!&|?{;~^>])|(?<=[(,=:\[!&|?{;~^>] )|(?<=[(,=:\[!&|?{;~^>]\n)|(?<=return ))/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_JS_TOKEN = re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|{_REGEX}|{_TEMPLATE}|" + _TOKEN.pattern)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:(?!\*/)[^\n\\]|\\[\s\S])*", re.M)
_RUST_LIFE = re.compile(r"'[A-Za-z_]\w*(?!')")
#: Words and signs that add a branch, by language.
BRANCHES = {
    "JavaScript": {"if", "for", "while", "do", "catch", "case", "?", "&&", "||", "??"},
    "Go": {"if", "for", "case", "select", "&&", "||"},
    "Rust": {"if", "while", "for", "loop", "=>", "&&", "||"},
    "Java": {"if", "for", "while", "do", "catch", "case", "default", "?", "&&", "||"},
    "C": {"if", "for", "while", "do", "case", "default", "?", "&&", "||"},
    "C++": {"if", "for", "while", "do", "case", "default", "?", "&&", "||", "catch"},
}
BRANCHES["TypeScript"] = BRANCHES["JavaScript"]
_KEYWORDS = frozenset("if for while switch catch return function do else try new typeof await case throw sizeof with match loop synchronized defined".split())


class Tokens:
    """Tokens without comments, their lines, and the partner of each bracket."""

    def __init__(self, text: str, language: str):
        if language in ("C", "C++"):
            text = _DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        pattern = _JS_TOKEN if language in ("JavaScript", "TypeScript") else _TOKEN
        if language == "Rust":
            text = _RUST_LIFE.sub(lambda m: " " * len(m[0]), text)
        self.text, self.at = [], []
        for m in pattern.finditer(text):
            t = m[0]
            if not t.startswith(("//", "/*")) and not (t == "#" and language in ("C", "C++")):
                self.text.append(t)
                self.at.append(m.start())
        ends = [m.start() for m in re.finditer("\n", text)]
        self.line = [bisect_right(ends, a - 1) + 1 for a in self.at]
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        self.balanced = True
        for i, t in enumerate(self.text):
            if t in "([{":
                stack.append(i)
            elif t in pairs:
                if stack and self.text[stack[-1]] == pairs[t]:
                    j = stack.pop()
                    self.partner[i], self.partner[j] = j, i
                else:
                    self.balanced = False
        if stack:
            self.balanced = False

    def end_line(self, i: int) -> int:
        return self.line[self.partner.get(i, len(self.line) - 1)]

    def branches(self, start: int, language: str) -> int:
        words = BRANCHES[language]
        stop = self.partner.get(start, len(self.text))
        n = 0
        for i in range(start, stop):
            t = self.text[i]
            if t in words:
                if t == "?" and language in ("TypeScript", "JavaScript") and self.text[i + 1 : i + 2] in ([":"], [","], [")"], ["="]):
                    continue
                if t == "default" and self.text[i + 1 : i + 2] not in ([":"], ["->"]):
                    continue
                if t == "do" and language != "Rust":
                    n += 1
                    continue
                if t == "while" and i and self.text[i - 1] == "}" and language != "Rust":
                    j = self.partner.get(i - 1)
                    if j and self.text[j - 1] == "do":
                        continue
                n += 1
        return n

    def params(self, i: int, language: str) -> list[str]:
        """Names of a parameter list whose bracket opens at i."""
        out, depth, part = [], 0, []
        for t in [*self.text[i + 1 : self.partner.get(i, i + 1)], ","]:
            if t in "([{<":
                depth += 1
            elif t in ")]}>":
                depth -= 1
            if t == "," and depth <= 0:
                if name := self._param(part, language):
                    out.append(name)
                part = []
            else:
                part.append(t)
        return out

    def _param(self, part: list[str], language: str) -> str | None:
        part = [p for p in part if p not in ("final", "mut", "public", "private", "protected", "readonly", "&", "ref")]
        if not part or part in (["self"], ["void"]):
            return None
        if language in ("JavaScript", "TypeScript"):
            if part[0] in "{[":
                return "{...}" if part[0] == "{" else "[...]"
            rest = part[0] == "..."
            name = part[1] if rest and len(part) > 1 else part[0]
            if "=" in part and language == "JavaScript":
                return None
            return f"...{name}" if rest else name
        if language in ("Go", "Rust"):
            return part[0] if re.match(r"[A-Za-z_]", part[0]) else None
        names = [p for p in part if re.fullmatch(r"[A-Za-z_]\w*", p)]
        return names[-1] if names else None


def _fn(name, params, start, end, is_async=False, method=False) -> dict:
    return {"name": name, "params": params, "line_start": start, "line_end": end, "docstring": None, "is_async": is_async, "is_method": method}


_HIDDEN = re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|"""[\s\S]*?"""|\br(?P<h>#*)"[\s\S]*?"(?P=h)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`')


def visible(text: str, language: str) -> str:
    """The text with comments and literals of more than one line blanked; literals of a line stay, because imports are made of them."""

    def blank(m: re.Match) -> str:
        if m[0][0] in "\"'" and not m[0].startswith('"""') or m[0][0] == "`" and language not in ("JavaScript", "TypeScript") and "\n" not in m[0]:
            return m[0]
        return re.sub(r"[^\n]", " ", m[0])

    return _HIDDEN.sub(blank, _RUST_LIFE.sub(lambda m: " " * len(m[0]), text) if language == "Rust" else text)


def _imports(text: str, language: str) -> list[dict]:
    out, text = [], visible(text, language)
    if language in ("JavaScript", "TypeScript"):
        for m in re.finditer(r"^[ \t]*import\s+(?:type\s+)?(?:([\w$*{},\s]+?)\s+from\s+)?[\"']([^\"']+)[\"']", text, re.M):
            names = []
            if m[1]:
                braces = re.search(r"\{([^}]*)\}", m[1])
                head = re.sub(r"\{[^}]*\}", "", m[1])
                star = re.search(r"\*\s+as\s+([\w$]+)", head)
                names += [w for w in re.findall(r"[\w$]+", re.sub(r"\*\s+as\s+[\w$]+", "", head))]
                names += [f"* as {star[1]}"] if star else []
                names += [p.split(" as ")[0].strip() for p in braces[1].split(",") if p.strip()] if braces else []
            out.append({"module": m[2], "names": names, "is_from_import": True})
    elif language == "Go":
        for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", text, re.M):
            out += [{"module": x, "names": [], "is_from_import": False} for x in (re.findall(r'"([^"]+)"', m[1]) if m[1] is not None else [m[2]])]
    elif language == "Java":
        for m in re.finditer(r"^\s*import\s+((?:static\s+)?[\w.]+(?:\.\*)?)\s*;", text, re.M):
            module, _, name = m[1].rpartition(".")
            out.append({"module": module, "names": [name], "is_from_import": True})
    elif language == "Rust":
        for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", text, re.M):
            path = re.sub(r"\s+", " ", m[1]).strip()
            module, sep, group = path.partition("::{")
            if sep:
                names = [x.strip() for x in group.rstrip("}").split(",") if x.strip()]
            else:
                module, _, last = path.rpartition("::")
                module, names = (module, [last]) if module else (path, [])
            out.append({"module": module, "names": names, "is_from_import": True})
    else:
        out += [{"module": m[1], "names": [], "is_from_import": False} for m in re.finditer(r"^\s*#\s*include\s+(<[^>\n]+>|\"[^\"\n]+\")", text, re.M)]
    return out


def parse(text: str, language: str) -> Symbols:
    out = empty()
    t = Tokens(text, language)
    if not t.balanced:
        out["parse_error"], out["parse_error_detail"] = True, "brackets do not match"
    out["imports"] = _imports(text, language)
    {"JavaScript": _js, "TypeScript": _js, "Go": _go, "Rust": _rust, "Java": _java}.get(language, _c)(t, out, language)
    return out


def _score(out: Symbols, name: str, value: int) -> None:
    out["complexity"][name] = max(out["complexity"].get(name, 0), value)


def _skip(t: Tokens, i: int, stop: tuple[str, ...]) -> int:
    """Next token in ``stop`` at this depth."""
    n = len(t.text)
    while i < n and t.text[i] not in stop:
        i = t.partner[i] + 1 if t.text[i] in "([{" and i in t.partner else i + 1
    return i


def _methods(t: Tokens, body: int, out: Symbols, language: str) -> list[str]:
    names, i, stop = [], body + 1, t.partner.get(body, len(t.text))
    while i < stop:
        x = t.text[i]
        if re.match(r"[A-Za-z_$#]", x) and i + 1 < stop and t.text[i + 1] == "(" and x not in _KEYWORDS and i + 1 in t.partner and t.text[i - 1] != "@":
            brace = _skip(t, t.partner[i + 1] + 1, ("{", ";", "}"))
            if brace < stop and t.text[brace] == "{":
                names.append(x)
                begin = i
                while begin > body + 1 and t.text[begin - 1] in ("async", "static", "get", "set", "public", "private", "protected", "override", "abstract", "readonly", "*"):
                    begin -= 1
                out["functions"].append(_fn(x, t.params(i + 1, language), t.line[begin], t.end_line(brace), "async" in t.text[begin:i], True))
                _score(out, x, 1 + t.branches(brace, language))
                i = t.partner.get(brace, stop) + 1
                continue
        i = t.partner[i] + 1 if x in "([{" and i in t.partner else i + 1
    return names


def _js(t: Tokens, out: Symbols, language: str) -> None:
    i, n = 0, len(t.text)
    while i < n:
        x = t.text[i]
        start = i
        while start and t.text[start - 1] in ("export", "default", "async", "abstract", "declare"):
            start -= 1
        if x == "function":
            j = i + 1 + (t.text[i + 1 : i + 2] == ["*"])
            paren = _skip(t, j, ("(",)) if j < n else n
            brace = _skip(t, t.partner.get(paren, n) + 1, ("{", ";")) if paren < n else n
            if brace < n and t.text[brace] == "{" and t.text[j] != "(":
                out["functions"].append(_fn(t.text[j], t.params(paren, language), t.line[i - (i > 0 and t.text[i - 1] == "async")], t.end_line(brace), i > 0 and t.text[i - 1] == "async"))
                _score(out, t.text[j], 1 + t.branches(brace, language))
                i = t.partner.get(brace, n)
        elif x == "class" and i + 1 < n:
            brace = _skip(t, i + 1, ("{",))
            if brace < n:
                head = t.text[i + 2 : brace]
                bases = []
                if "extends" in head:
                    k = head.index("extends") + 1
                    base = head[k] if k < len(head) else ""
                    while k + 2 < len(head) and head[k + 1] == ".":
                        base, k = f"{base}.{head[k + 2]}", k + 2
                    bases = [base] if base else []
                c = {"name": t.text[i + 1], "bases": bases, "method_names": [], "line_start": t.line[i], "line_end": t.end_line(brace), "docstring": None}
                out["classes"].append(c)
                c["method_names"] = _methods(t, brace, out, language)
                i = t.partner.get(brace, n)
        elif x in ("const", "let", "var") and i + 2 < n:
            eq = _skip(t, i + 1, ("=", ";"))
            if eq < n and t.text[eq] == "=":
                k = eq + 1
                is_async = t.text[k : k + 1] == ["async"]
                k += is_async
                arrow = _skip(t, k, ("=>", ";"))
                if arrow < n and t.text[arrow] == "=>" and arrow - k < 400:
                    brace = arrow + 1
                    params = t.params(k, language) if t.text[k] == "(" else [t.text[k]]
                    end = t.end_line(brace) if brace < n and t.text[brace] == "{" else t.line[min(_skip(t, brace, (";",)), n - 1)]
                    out["functions"].append(_fn(t.text[i + 1], params, t.line[i], end, is_async))
                    if brace < n and t.text[brace] == "{":
                        _score(out, t.text[i + 1], 1 + t.branches(brace, language))
                    i = t.partner.get(brace, brace)
        elif x in "([{" and i in t.partner:
            i = t.partner[i]
        i += 1


def _go(t: Tokens, out: Symbols, language: str) -> None:
    for i, x in enumerate(t.text):
        if x == "func" and i + 2 < len(t.text):
            j = t.partner.get(i + 1, i) + 1 if t.text[i + 1] == "(" else i + 1
            if j + 1 < len(t.text) and re.match(r"[A-Za-z_]", t.text[j]) and "(" in t.text[j + 1 : j + 2] + ["["]:
                paren = _skip(t, j + 1, ("(",))
                brace = _skip(t, t.partner.get(paren, paren) + 1, ("{", "func", "type", "var", "const"))
                if brace < len(t.text) and t.text[brace] == "{":
                    out["functions"].append(_fn(t.text[j], t.params(paren, language), t.line[i], t.end_line(brace)))
                    _score(out, t.text[j], 1 + t.branches(brace, language))
        elif x == "type" and t.text[i + 2 : i + 3] and t.text[i + 2] in ("struct", "interface"):
            brace = _skip(t, i + 2, ("{",))
            out["classes"].append({"name": t.text[i + 1], "bases": [], "method_names": [], "line_start": t.line[i], "line_end": t.end_line(brace) if brace < len(t.text) else t.line[i], "docstring": None})


def _rust(t: Tokens, out: Symbols, language: str) -> None:
    inside: list[tuple[int, int]] = []
    methods: dict[str, list[str]] = {}
    kinds: dict[str, dict] = {}
    for i, x in enumerate(t.text):
        if x in ("impl", "trait", "struct", "enum") and i + 1 < len(t.text):
            brace = _skip(t, i + 1, ("{", ";"))
            head = t.text[i + 1 : brace]
            if x in ("impl", "trait") and brace < len(t.text) and t.text[brace] == "{":
                stop = t.partner.get(brace, len(t.text))
                inside.append((brace, stop))
                owner = head[head.index("for") + 1] if x == "impl" and "for" in head and head.index("for") + 1 < len(head) else next((w for w in reversed(head) if re.match(r"[A-Za-z_]", w)), "") if x == "impl" else head[0] if head else ""
                if x == "impl" and "<" in head and "for" not in head:
                    owner = next((w for w in head if re.match(r"[A-Z]\w+", w)), owner)
                names = [t.text[k + 1] for k in range(brace, stop) if t.text[k] == "fn" and k + 1 < stop]
                methods.setdefault(owner, []).extend(names)
            if x != "impl" and head:
                end = t.end_line(brace) if brace < len(t.text) and t.text[brace] == "{" else t.line[min(brace, len(t.line) - 1)]
                kinds[head[0]] = {"name": head[0], "bases": [], "method_names": [], "line_start": t.line[i], "line_end": end, "docstring": None}
                out["classes"].append(kinds[head[0]])
        elif x == "fn" and i + 1 < len(t.text):
            paren = _skip(t, i + 1, ("(",))
            brace = _skip(t, t.partner.get(paren, paren) + 1, ("{", ";")) if paren < len(t.text) else len(t.text)
            if brace < len(t.text) and t.text[brace] == "{":
                out["functions"].append(_fn(t.text[i + 1], t.params(paren, language), t.line[i], t.end_line(brace), "async" in t.text[max(0, i - 2) : i], any(a < i < b for a, b in inside)))
                _score(out, t.text[i + 1], 1 + t.branches(brace, language))
    for name, kind in kinds.items():
        kind["method_names"] = methods.get(name, [])


def _java(t: Tokens, out: Symbols, language: str) -> None:
    for i, x in enumerate(t.text):
        if x in ("class", "interface", "enum", "record") and i + 1 < len(t.text) and re.match(r"[A-Za-z_]", t.text[i + 1]) and (not i or t.text[i - 1] != "."):
            brace = _skip(t, i + 1, ("{", ";"))
            if brace >= len(t.text) or t.text[brace] != "{":
                continue
            head = " ".join(t.text[i + 2 : brace])
            bases = [b.strip() for k in re.findall(r"(?:extends|implements)\s+(.*?)(?=\bimplements\b|\bextends\b|$)", head) for b in re.sub(r"<.*?>", "", k).split(",") if b.strip()]
            c = {"name": t.text[i + 1], "bases": [re.sub(r"\s+", "", b) for b in bases], "method_names": [], "line_start": t.line[i], "line_end": t.end_line(brace), "docstring": None}
            out["classes"].append(c)
            c["method_names"] = _methods(t, brace, out, language)


def _c(t: Tokens, out: Symbols, language: str) -> None:
    i, n = 0, len(t.text)
    while i < n:
        x = t.text[i]
        if x == "class" and language in ("C++", "C++ Header") and i + 1 < n:
            brace = _skip(t, i + 1, ("{", ";"))
            if brace < n and t.text[brace] == "{":
                head = t.text[i + 2 : brace]
                bases = [w for w in head if re.match(r"[A-Za-z_]", w) and w not in ("public", "private", "protected", "virtual", "final")]
                c = {"name": t.text[i + 1], "bases": bases, "method_names": [], "line_start": t.line[i], "line_end": t.end_line(brace), "docstring": None}
                out["classes"].append(c)
                defined = _methods(t, brace, out, "C++")
                declared = [t.text[k] for k in range(brace, t.partner.get(brace, n) - 1) if t.text[k + 1] == "(" and re.match(r"[A-Za-z_]", t.text[k]) and t.text[k] not in _KEYWORDS and t.text[t.partner.get(k + 1, k) + 1 : t.partner.get(k + 1, k) + 2] == [";"]]
                c["method_names"] = [*defined, *[d for d in declared if d not in defined]]
                i = t.partner.get(brace, n)
        elif x == "(" and i and re.match(r"[A-Za-z_]", t.text[i - 1]) and t.text[i - 1] not in _KEYWORDS and i in t.partner:
            brace = t.partner[i] + 1
            while brace < n and t.text[brace] in ("const", "noexcept", "override", "final"):
                brace += 1
            if brace < n and t.text[brace] == "{":
                begin = i - 1
                while begin and re.match(r"[A-Za-z_*&:<>]", t.text[begin - 1]) and t.text[begin - 1] not in ("}", ";"):
                    begin -= 1
                out["functions"].append(_fn(t.text[i - 1], t.params(i, language), t.line[begin], t.end_line(brace)))
                _score(out, t.text[i - 1], 1 + t.branches(brace, "C++" if language.startswith("C++") else "C"))
                i = t.partner.get(brace, n)
            else:
                i = t.partner[i]
        elif x == "{" and t.text[max(0, i - 2) : i] and t.text[i - 1] != "=" and i in t.partner and not re.match(r"namespace|extern", " ".join(t.text[max(0, i - 2) : i])) and t.text[max(0, i - 2)] not in ("namespace", "extern"):
            i = t.partner[i]
        i += 1
