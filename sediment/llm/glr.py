"""Table-driven generalised LR recogniser over bundled grammars.

A grammar file holds rules ``name : alternative | alternative ;`` in an EBNF: quoted
symbols and upper-case words are terminals, ``x?``, ``x*``, ``x+`` and ``( .. )`` repeat
and group.  Optional parts are expanded into alternatives, so no rule derives the empty
string and no stack can grow without input.

The recogniser is SLR(1) with all conflicts kept: a configuration is the set of LR stacks
that are alive.  Stacks are hash-consed, so equal stacks are one object, and configurations
are interned and carry their own transition table (terminal -> configuration), which is
filled when a transition is first taken.  Code returns to the same configuration after
every statement, so nearly every token costs one dictionary lookup.  LR(0) item sets are
built on demand in the same way.  Emptying the tables when they are large changes nothing
but speed.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

_WORD = re.compile(r"\s+|//[^\n]*|('(?:[^'\\]|\\.)+'|[A-Za-z_][\w]*|[:|;()?*+])")


class Grammar:
    """Productions, FOLLOW sets and lazily built LR(0) states of one language."""

    def __init__(self, text: str, start: str, banned: dict[str, tuple[str, tuple[str, ...]]] | None = None):
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self._fresh = 0
        self._read(text)
        for name, (of, firsts) in (banned or {}).items():
            self._restrict(f"<{name}>", f"<{of}>", set(firsts))
        unknown = {s for alts in self.rules.values() for a in alts for s in a if s[0] == "<" and s[-1] == ">" and len(s) > 2 and s not in self.rules}
        if unknown:
            raise ValueError(f"no rules for {sorted(unknown)}")
        self.terminals = {s for alts in self.rules.values() for a in alts for s in a if s not in self.rules}
        if "ANY" in self.terminals:
            self.terminals.discard("ANY")
            self.rules["ANY"] = [(t,) for t in sorted(self.terminals - set("()[]{}"))]
        self.start = f"<{start}>"
        self.prods: list[tuple[str, tuple[str, ...]]] = [("$start", (self.start,))]
        self.of: dict[str, list[int]] = {}
        for name, alts in self.rules.items():
            self.of[name] = []
            for a in dict.fromkeys(alts):
                self.of[name].append(len(self.prods))
                self.prods.append((name, a))
        self._follow()
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.gotos: list[dict[str, int]] = []
        self.reductions: list[list[tuple[str, int, frozenset]]] = []
        self.state(frozenset({(0, 0)}))

    # reading ------------------------------------------------------------
    def _read(self, text: str) -> None:
        toks = [t for t in _WORD.findall(text) if t]
        i = 0
        while i < len(toks):
            name = f"<{toks[i]}>"
            if toks[i + 1] != ":":
                raise ValueError(f"rule {name}: ':' expected, got {toks[i + 1]}")
            alts, i = self._alts(toks, i + 2)
            if toks[i] != ";":
                raise ValueError(f"rule {name}: ';' expected, got {toks[i]}")
            i += 1
            if any(not a for a in alts):
                raise ValueError(f"rule {name} derives the empty string")
            self.rules.setdefault(name, []).extend(alts)

    def _alts(self, toks: list[str], i: int) -> tuple[list[tuple[str, ...]], int]:
        out: list[tuple[str, ...]] = []
        current: list[tuple[str, ...]] = [()]
        while toks[i] not in (";", ")"):
            if toks[i] == "|":
                out, current, i = out + current, [()], i + 1
                continue
            if toks[i] == "(":
                inner, i = self._alts(toks, i + 1)
                i += 1
            else:
                t = toks[i]
                inner, i = [(t[1:-1] if t[0] == "'" else t if t.isupper() else f"<{t}>",)], i + 1
            while i < len(toks) and toks[i] in ("?", "*", "+"):
                if toks[i] in "*+":
                    self._fresh += 1
                    name = f"<list {self._fresh}>"
                    self.rules[name] = [a for a in inner if a] + [(name, *a) for a in inner if a]
                    plus = (name,)
                if toks[i] == "?":
                    inner = [(), *inner]
                else:
                    inner = [(), plus] if toks[i] == "*" else [plus]
                i += 1
            current = [c + a for c in current for a in inner]
        return out + current, i

    def _restrict(self, name: str, of: str, firsts: set[str]) -> None:
        """Add ``name``: what ``of`` derives without beginning with a symbol in ``firsts``."""
        spine, todo = {of: name}, [of]
        while todo:
            x = todo.pop()
            for a in self.rules[x]:
                if a[0] in self.rules and a[0] not in spine:
                    spine[a[0]] = f"{a[0]}~{name}"
                    todo.append(a[0])
        for x, y in spine.items():
            self.rules[y] = [(spine.get(a[0], a[0]), *a[1:]) for a in self.rules[x] if a[0] not in firsts]
        empty = True
        while empty:
            empty = {y for y in spine.values() if not self.rules.get(y, True)}
            for y in empty:
                del self.rules[y]
            for x in list(self.rules):
                self.rules[x] = [a for a in self.rules[x] if not empty & set(a)]

    def _follow(self) -> None:
        first: dict[str, set[str]] = {n: set() for n in self.rules}
        changed = True
        while changed:
            changed = False
            for name, a in self.prods[1:]:
                more = first[a[0]] if a[0] in first else {a[0]}
                if not more <= first[name]:
                    first[name] |= more
                    changed = True
        follow: dict[str, set[str]] = {n: set() for n in self.rules}
        follow[self.start].add("$")
        edges: dict[str, set[str]] = {n: set() for n in self.rules}
        for name, a in self.prods[1:]:
            for x, y in zip(a, a[1:]):
                if x in follow:
                    follow[x] |= first.get(y, {y})
            if a[-1] in edges:
                edges[name].add(a[-1])
        changed = True
        while changed:
            changed = False
            for name, into in edges.items():
                for x in into:
                    if not follow[name] <= follow[x]:
                        follow[x] |= follow[name]
                        changed = True
        self.follow = {n: frozenset(f) for n, f in follow.items()}

    # LR(0) states -------------------------------------------------------
    def state(self, kernel: frozenset) -> int:
        if kernel in self.number:
            return self.number[kernel]
        items, todo = set(kernel), list(kernel)
        while todo:
            p, d = todo.pop()
            rhs = self.prods[p][1]
            if d < len(rhs) and rhs[d] in self.of:
                for q in self.of[rhs[d]]:
                    if (q, 0) not in items:
                        items.add((q, 0))
                        todo.append((q, 0))
        n = self.number[kernel] = len(self.states)
        moves: dict[str, set] = {}
        done = []
        for p, d in items:
            name, rhs = self.prods[p]
            if d < len(rhs):
                moves.setdefault(rhs[d], set()).add((p, d + 1))
            elif p:
                done.append((name, len(rhs), self.follow[name]))
        self.states.append(frozenset(items))
        self.gotos.append({s: frozenset(k) for s, k in moves.items()})
        self.reductions.append(done)
        return n

    def goto(self, state: int, symbol: str) -> int | None:
        to = self.gotos[state].get(symbol)
        if to.__class__ is frozenset:
            to = self.gotos[state][symbol] = self.state(to)
        return to


class _Stack:
    __slots__ = ("state", "below", "__weakref__")

    def __init__(self, state, below):
        self.state, self.below = state, below


class Config(dict):
    """A set of live stacks plus what the language's layout rules have to remember; maps a terminal to the next one."""

    __slots__ = ("stacks", "aux", "machine", "prev")

    def __missing__(self, kind):
        to = self[kind] = self.machine.layout(self, kind) if self.stacks else self
        return to


class Machine:
    """Recogniser of one grammar.  ``layout`` is overridden for languages in which line ends matter."""

    LIMIT = 400_000

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.clear()

    def clear(self) -> None:
        self.conses: dict[tuple, _Stack] = {}
        self.configs: dict[tuple, Config] = {}
        self.dead = Config()
        self.dead.stacks, self.dead.aux, self.dead.machine = frozenset(), None, self
        root = self._cons(0, None)
        self.first = self.config(frozenset({root}), self.begin())

    def begin(self):
        return None

    def _cons(self, state: int, below: _Stack | None) -> _Stack:
        key = (state, id(below))
        s = self.conses.get(key)
        if s is None:
            s = self.conses[key] = _Stack(state, below)
        return s

    def config(self, stacks: frozenset, aux) -> Config:
        if not stacks:
            return self.dead
        key = (stacks, aux)
        c = self.configs.get(key)
        if c is None:
            c = self.configs[key] = Config()
            c.stacks, c.aux, c.machine = stacks, aux, self
        return c

    def shift(self, stacks: frozenset, kind: str) -> frozenset:
        """All stacks after the reductions that ``kind`` allows and its shift."""
        g, out, todo, seen = self.grammar, set(), list(stacks), set(stacks)
        while todo:
            s = todo.pop()
            to = g.goto(s.state, kind)
            if to is not None:
                out.add(self._cons(to, s))
            for name, n, follow in g.reductions[s.state]:
                if kind in follow:
                    b = s
                    for _ in range(n):
                        b = b.below
                    r = self._cons(g.goto(b.state, name), b)
                    if r not in seen:
                        seen.add(r)
                        todo.append(r)
        return frozenset(out)

    def accepts(self, stacks: frozenset) -> bool:
        g, todo, seen = self.grammar, list(stacks), set(stacks)
        while todo:
            s = todo.pop()
            if s.below is not None and s.below.below is None and (0, 1) in g.states[s.state]:
                return True
            for name, n, follow in g.reductions[s.state]:
                if "$" in follow:
                    b = s
                    for _ in range(n):
                        b = b.below
                    to = g.goto(b.state, name)
                    if to is not None and (r := self._cons(to, b)) not in seen:
                        seen.add(r)
                        todo.append(r)
        return False

    def layout(self, c: Config, kind: str) -> Config:
        if kind == "SKIP":
            return c
        return self.config(self.shift(c.stacks, kind), c.aux)

    def end(self, c: Config) -> bool:
        return self.accepts(c.stacks)

    def run(self, kinds, texts: list[str]) -> int | None:
        """None if the tokens are a sentence; else the index of the first token that cannot follow (the length: input ended too soon)."""
        if len(self.conses) > self.LIMIT or len(self.configs) > self.LIMIT:
            self.clear()
        c = self.first
        for k in map(kinds, texts):
            c = c[k]
        if c is not self.dead:
            return None if self.end(c) else len(texts)
        c = self.first
        for i, k in enumerate(map(kinds, texts)):
            c = c[k]
            if c is self.dead:
                return i
        raise AssertionError


@cache
def text_of(name: str) -> str:
    return (Path(__file__).parent / "grammars" / f"{name}.bnf").read_text(encoding="utf-8")
