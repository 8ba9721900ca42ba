"""Symbols and complexity of Python files, from the interpreter's own parser."""

from __future__ import annotations

import ast
import re
import warnings

Symbols = dict


def empty(error: str | None = None) -> Symbols:
    return {"module_docstring": None, "functions": [], "classes": [], "imports": [], "parse_error": error is not None, "parse_error_detail": error, "complexity": {}}


def _docstring(node) -> str | None:
    text = ast.get_docstring(node, clean=False)
    return (text.strip() or None) if text else None


def _params(a: ast.arguments) -> list[str]:
    out = [p.arg for p in (*a.posonlyargs, *a.args)]
    if a.vararg:
        out.append(f"*{a.vararg.arg}")
    out += [p.arg for p in a.kwonlyargs]
    return out + ([f"**{a.kwarg.arg}"] if a.kwarg else [])


def _function(node, method: bool) -> dict:
    return {"name": node.name, "params": _params(node.args), "line_start": node.lineno, "line_end": node.end_lineno, "docstring": _docstring(node), "is_async": isinstance(node, ast.AsyncFunctionDef), "is_method": method}


def _base(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (left := _base(node.value)):
        return f"{left}.{node.attr}"
    return None


def branches(node: ast.AST) -> int:
    """Decision points: if, loops and their else, except, assert, comprehensions and their conditions, boolean operands, match cases, conditional expressions."""
    n = 0
    for x in ast.walk(node):
        if isinstance(x, (ast.If, ast.IfExp, ast.ExceptHandler, ast.Assert)):
            n += 1
        elif isinstance(x, (ast.For, ast.AsyncFor, ast.While)):
            n += 1 + bool(x.orelse)
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.match_case):
            n += not (isinstance(x.pattern, ast.MatchAs) and x.pattern.pattern is None)
    return n


def parse(text: str) -> Symbols:
    """Top-level functions, classes with their methods, imports, docstrings, and complexity by name.

    A file that does not parse keeps what its lines at the left margin say.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return _recover(text, f"{type(e).__name__}: {e}")
    out = empty()
    out["module_docstring"] = _docstring(tree)
    score: dict[str, int] = out["complexity"]
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["functions"].append(_function(node, False))
            score[node.name] = max(score.get(node.name, 0), 1 + branches(node))
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            out["classes"].append({"name": node.name, "bases": [b for b in map(_base, node.bases) if b], "method_names": [m.name for m in methods], "line_start": node.lineno, "line_end": node.end_lineno, "docstring": _docstring(node)})
            for m in methods:
                out["functions"].append(_function(m, True))
                key = f"{node.name}.{m.name}"
                score[key] = max(score.get(key, 0), 1 + branches(m))
        elif isinstance(node, ast.Import):
            out["imports"].append({"module": ", ".join(a.name for a in node.names), "names": [], "is_from_import": False})
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append({"module": "." * node.level + (node.module or ""), "names": [a.name for a in node.names], "is_from_import": True})
    return out


_DEF = re.compile(r"^(async\s+)?def\s+(\w+)\s*\(([^)]*)\)?")
_CLASS = re.compile(r"^class\s+(\w+)\s*(?:\(([^)]*)\))?")
_FROM = re.compile(r"^from\s+([.\w]+)\s+import\s+\(?([\w\s,*]+)")
_IMPORT = re.compile(r"^import\s+([\w., ]+)")


def _recover(text: str, error: str) -> Symbols:
    out = empty(error)
    lines = text.split("\n")
    starts = [i for i, line in enumerate(lines) if line[:1].strip() and line[:1] not in "#)]}"] + [len(lines)]
    for i, end in zip(starts, starts[1:]):
        line = lines[i]
        if m := _DEF.match(line):
            out["functions"].append({"name": m[2], "params": [p.split(":")[0].split("=")[0].strip() for p in (m[3] or "").split(",") if p.strip()], "line_start": i + 1, "line_end": end, "docstring": None, "is_async": bool(m[1]), "is_method": False})
        elif m := _CLASS.match(line):
            out["classes"].append({"name": m[1], "bases": [b.strip() for b in (m[2] or "").split(",") if re.fullmatch(r"\s*[\w.]+\s*", b)], "method_names": re.findall(r"^[ \t]+(?:async\s+)?def\s+(\w+)", "\n".join(lines[i + 1 : end]), re.M), "line_start": i + 1, "line_end": end, "docstring": None})
        elif m := _FROM.match(line):
            out["imports"].append({"module": m[1], "names": [n.split(" as ")[0].strip() for n in m[2].split(",") if n.strip()], "is_from_import": True})
        elif m := _IMPORT.match(line):
            out["imports"].append({"module": m[1].strip(), "names": [], "is_from_import": False})
    return out
