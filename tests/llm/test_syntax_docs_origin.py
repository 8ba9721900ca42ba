import ast
import warnings

import pytest

from sediment.llm import lexers, p1_syntax, p2_docs, p3_origin

FILES = "file_id bigint, language string, extra int"
CONTENTS = "file_id bigint, repo string, path string, content string, language string"

VALID = {
    "Python": ["", "# only\n", "x = 1\n", "def f(a, /, b=1, *, c: int = 2, **k) -> int:\n  return a\n", "match x:\n  case [1, *_] if y: pass\n  case _:\n    pass\n", "f'{a!r:>{w}} {b[\"c\"]}'\n", "async def g():\n\tasync with a as b, c: pass\n", "try:\n  pass\nexcept* E as e:\n  pass\n", "x = [i async for i in y if i]\nlambda *a, k=1: (yield)\n", "type X[T] = list[T]\n", "if a:\n    b\n\n# c\n  # odd\nelse:\n    c\n", "a = b\\\n + 1\r\n", "@d\nclass A[T](B, metaclass=M): x: int = 1; y: str\n", "print(*a, **b, c=1)\nx[1:2, ::3] += -1\n", "with (open(a) as f, b): pass\n", "del a, b[0]\nfor x, in y: pass\n"],
    "JavaScript": ["a\nb", "const {a, ...b} = c, [d = 1] = e", "x = a / b / c; y = /[/]\\/x/g.test(z)", "for (const x of y) if (a) b; else { c }", "class A extends B { static #p = 1; get x() { return this.#p } async *m() {} }", "export default () => ({a: 1})", "let s = `a${b + `c${d}`}e`", "return_ = async (x) => await x?.y?.[0]", "do x++; while (x < 5)\nfoo()", "label: for (;;) { continue label }", "import a, {b as c} from 'd'; export * as e from 'f'", "var o = { async *f() {}, get g() { return 1 }, [h]: 2, if: 3 }", "a = b ? c : d => e", "x = y\n++z", "switch (a) { case 1: b; default: c }"],
    "TypeScript": ["const a: Map<string, Array<number>> = new Map()", "function f<T extends A>(x?: T, ...y: number[]): x is B { return x as unknown as B }", "interface A<T> extends B { [k: string]: T; m?(x: number): void; readonly y: 'z' | 1 }", "abstract class A implements B { private constructor(readonly x: number) { super() } abstract m(): void; y!: string }", "type A = { [K in keyof B]?: B[K] } | (() => void)", "enum E { A = 1, B }", "export type { A } from 'b'; declare module 'x' { const y: number }", "@dec() class A { @p x = 1 }", "let x = <T,>(y: T) => y", "if (a < b && c > d) { e!.f }", "out.warn(`x`); type.y = 1", "let t: [a: string, b?: number] = f<string>(1)"],
    "Go": ["package a\n", "package a\nimport (\n\t\"b\"\n)\nfunc f[T any](x, y int, z ...string) (int, error) {\n\tif v, ok := m[k]; ok {\n\t\treturn v, nil\n\t}\n\tfor i := range x {\n\t}\n\tswitch t := x.(type) {\n\tcase int, *string:\n\tdefault:\n\t}\n\tgo func() {}()\n\tch <- 1\n\treturn 0, nil\n}\n", "package a\ntype S struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\nvar x = map[string][]int{\"a\": {1, 2}}\nconst (\n\tA = iota\n\tB\n)\n"],
    "Java": ["package a.b;\nimport static c.D.*;\n@X(y = {1, 2}) public class A<T extends B & C> extends D implements E, F { private final int[] x = {1, 2,}; A() { this.x = null; } <U> List<? super U> m(int... y) throws Z { for (var a : b) { } try (R r = f()) { } catch (A | B e) { } finally { } return (a, b) -> a; } enum Q { A(1) { }, B; int z; } }", "record P(int x, String y) { P { if (x > 0) throw new E(); } }", "class S { int f(Object o) { return switch (o) { case String s when s.isEmpty() -> 1; case A(var x) -> { yield 2; } default -> (int) 3L; }; } String t = \"\"\"\n a \"b\" \"\"\"; boolean b = o instanceof String s && x < y; Runnable r = A::new; int[][] z = new int[3][]; }"],
    "Rust": ["use a::{b as c, d::*};\n#[derive(X)]\npub struct S<'a, T: B + 'a> where T: C { pub x: &'a mut [T; 3] }\nimpl<T> A for S<'_, T> { fn f(&mut self, (a, b): (u8, u8)) -> Option<u64> { let x = match y { Some(1..=3) | None if z => 4, A::B { c, .. } => { 5 } _ => return None, }; if let Some(q) = r { s?; } for i in 0..n { println!(\"{}\", i); } let f = |a: u8| a as u16 + 1; x.iter().map::<u8, _>(|&v| v << 2).collect::<Vec<_>>() } }\n", "macro_rules! m { ($x:expr) => { $x } }\nconst C: char = 'a'; static S: &'static str = r#\"a\"b\"#;\n", "fn main() { loop { break 'a'; } }\nenum E { A(u8), B { x: i32 }, C = 3 }\n"],
    "C": ["#include <a.h>\n#define X(y) \\\n  (y)\ntypedef struct n { int x : 3; struct n *next; } n_t;\nstatic const char *f(int (*g)(void), unsigned long a[], ...) { for (int i = 0; i < 3; i++) { a[i] += (int) *p->q; } switch (x) { case 1: break; default: ; } return \"a\" \"b\"; }\nint v[] = { [0] = 1, 2 };\n", "enum e { A, B = 2 };\nint main(void) { T * x; goto end; end: return sizeof(T *); }\n"],
    "C++": ["int main() { return 0; }", "#include <v>\nnamespace a::b { template <typename T, int N = 3> class C : public D<T> { public: C(int x) : y(x), z{1} {} virtual ~C() = default; auto f() const -> int override; T operator+(const C &o) const { return y + o.y; } private: T y; }; }\nint g() { std::vector<std::pair<int, int>> v; for (const auto &[k, w] : v) { if (auto p = f<int>(k); p) {} } auto l = [&](auto x) mutable { return x; }; try { throw E(\"a\"); } catch (const E &e) { } return static_cast<int>(x.y) << 2; }\nusing X = std::map<int, A<B<C>>>;\n"],
}
INVALID = {
    "Python": ["def f(:\n", "if a:\nb\n", "x = (1\n", "a b\n", "<<<<<<< HEAD\nx\n=======\n", "  x = 1\n", "'abc\n", "package a\n\nimport \"b\"\n", "def f():\n    a\n  b\n", "1x = 2\n", "f'{a'\n", "try:\n  a\n"],
    "JavaScript": ["function f() {", "a b", "}", "const x: number = 1", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "`abc", "import a\nimport b", "# A heading\n\nText here.", "let x = ;", "if (a { }", "def f(x):\n  return 1"],
    "TypeScript": ["fn f() -> u8 {}", "class A {", "const a: = 1", "<!DOCTYPE html>"],
    "Go": ["func f() {}", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a.b;\n"],
    "Java": ["class A { int f() { return 1 } }", "class A {", "fn f() {}", "import a\n"],
    "Rust": ["fn f() {", "def f():\n  pass", "let x = 1;", "fn f() -> { }", "fn f() { (] }"],
    "C": ["int f() {", "int f() { return std::x(1); }", "int f( { }", "import a"],
    "C++": ["class A {", "int f() { int x = ; }", "def f():\n  pass"],
}


@pytest.mark.parametrize("lang", list(VALID))
def test_grammars(lang):
    assert [t for t in VALID[lang] if lexers.first_error(lang, t)] == []
    assert [t for t in INVALID[lang] if not lexers.first_error(lang, t)] == []


def test_python_grammar_agrees_with_the_interpreter():
    import pathlib

    import json as lib

    for path in sorted(pathlib.Path(lib.__file__).parent.glob("*.py")):
        text = path.read_text()
        assert lexers.first_error("Python", text) is None, path
        for cut in range(50, len(text), 997):
            part = text[:cut]
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    ast.parse(part)
                    ok = True
                except SyntaxError:
                    ok = False
            if ok != (lexers.first_error("Python", part) is None):
                assert ok is False and path.name != "", (path, cut)


def test_first_error_place():
    assert lexers.first_error("Go", "package a\n\nfunc f() {\n\tx y\n}\n") == (4, "y")
    assert lexers.first_error("Python", "a = 1\nb = = 2\n") == (2, "=")
    assert lexers.first_error("Java", "class A {\n") == (2, "")


def test_p1_rows(spark):
    rows = [(1, "r", "a.py", "x = 1\n", "Z"), (2, "r", "b.py", "x = (\n", "Z"), (2, "r", "b.py", "x = (\n", "Z"), (3, "r", "c.go", None, "Z"), (4, "r", "d.PY", "", "Z"), (5, "s", "e.md", "x = (", "Z"), (6, "s", None, "x", None), (7, "s", "f.js", "a" * 300_000 + "(", "Z")]
    contents = spark.createDataFrame(rows, CONTENTS)
    files = spark.createDataFrame([(i, lang, 0) for i, lang in ((1, "Python"), (2, "Python"), (3, "Go"), (4, "Python"), (5, "Markdown"), (7, "JavaScript"))] * 2, FILES)
    assert {r["file_id"] for r in p1_syntax.invalid_files(contents, files).collect()} == {2, 7}
    rates = {(r["repo"], r["language"]): (r["n_files"], r["n_parse_errors"]) for r in p1_syntax.error_rates(contents, files).collect()}
    assert rates == {("r", "Python"): (3, 1), ("s", "JavaScript"): (1, 1)}
    assert p1_syntax.invalid_files(contents.limit(0), files).count() == 0


GO = """package a

// Loads every pending row before the next retry.
func Load(x int) int {
\treturn x
}

// Detached from what follows by a blank line here.

func Bare() {}

// TODO write the docs for this one
func Todo() {}

// See the other module for all of the details.
func See() {}

/* renderBigValue */
func renderBigValue() {}

// Prüft die ganze Liste vor dem nächsten Versuch.
// @param x a number of rows
func Check() { s := "}" }
"""


def test_p2(spark):
    py = 'def f(a,\n      b=")"):\n    # note\n    """Return the number of rows that are left."""\n    return 1\n\ndef g():\n    """TODO."""\n\ndef h():\n    x = "This is no docstring of the function"\n'
    ts = "class A {\n  /**\n   * 这个加载器会比较最早的一条记录。\n   */\n  @dec({a: ')'})\n  m(x: string): void { if (x) { } }\n}\n"
    contents = spark.createDataFrame([(1, "r", "a.go", GO, "Z"), (2, "r", "b.py", py, "Z"), (3, "r", "c.ts", ts, "Z"), (4, "r", "d.go", "// This comment describes a broken file well.\nfunc X() {", "Z"), (5, "r", "e.py", None, "Z")] * 2, CONTENTS)
    fn = "file_id bigint, functions array<struct<name:string,line_start:int,docstring:string>>"
    lines = {n: i for i, line in enumerate(GO.split("\n"), 1) for n in ("Load", "Bare", "Todo", "See", "renderBigValue", "Check") if line.startswith(f"func {n}(")}
    symbols = spark.createDataFrame([(1, [(n, i, None) for n, i in lines.items()] + [("Load", 999, None), (None, 3, None), None]), (2, [("f", 1, None), ("g", 7, None), ("h", 10, None)]), (3, [("m", 6, None)]), (4, [("X", 2, None)]), (5, [("q", 1, None)]), (6, None)] * 2, fn)
    files = spark.createDataFrame([(i, lang, 0) for i, lang in ((1, "Go"), (2, "Python"), (3, "TypeScript"), (4, "Go"), (5, "Python"))], FILES)
    got = {(r["file_id"], r["name"]): r for r in p2_docs.documented(contents, symbols, files).collect()}
    assert set(got) == {(1, "Load"), (1, "Check"), (2, "f"), (3, "m")}
    assert got[1, "Check"]["code"].startswith("func Check") and got[1, "Check"]["code"].endswith("}") and '"}"' in got[1, "Check"]["code"]
    assert got[2, "f"]["description"] == "Return the number of rows that are left." and p2_docs.documented(contents, symbols, files, False).count() == 4


def test_p3(spark):
    minified = "!function(){" + "".join(f"if(a{i}===void 0){{b=[{i},c]}}" for i in range(80)) + "}();"
    table = "T = [\n" + "  12, 34, 56, 78, 90, 11, 22, 33,\n" * 40 + "]\n"
    blob = 'export const x = "' + "Ab3//9zQ" * 300 + '";\n'
    plain = "def f(a):\n    return a + 1\n" * 40
    cases = [("min.js", minified, "minified"), ("t.py", table, "data"), ("b.js", blob, "data"), ("p.py", plain, None), ("vendor/x/p.py", plain, "vendored"), ("src/vendors/p.py", plain, None), ("g.py", "# Code generated by xgen. DO NOT EDIT.\n" + plain, "generated"), ("g2.py", plain + "# AUTOGENERATED FILE, do not modify by hand\n", "generated"), ("talk.py", "# This module writes the do not edit banner into files that the compiler generated.\n" + plain, None), ("c.js", "// Bundled copy of abc 1.2.3, taken from upstream\nfoo();\n", "vendored"), ("u.py", plain + "# https://x.example/" + "a1" * 400 + "\n", None), ("s.py", "LIMITS = [1, 2, 3]\n" + plain, None), ("e.py", "", None), ("n.py", None, None)]
    contents = spark.createDataFrame([(i, "r", p, c, "Z") for i, (p, c, _) in enumerate(cases)] * 2, CONTENTS)
    files = spark.createDataFrame([(i, "JavaScript" if p.endswith("js") else "Python", 0) for i, (p, _, _) in enumerate(cases)], FILES)
    got = {r["file_id"]: r["origin"] for r in p3_origin.not_hand_written(contents, files).collect()}
    assert [got.get(i) for i in range(len(cases))] == [k for *_, k in cases]


def test_p3_literals_without_digits():
    words = "WORDS = [\n" + "".join(f'    "{a}{b}land",\n' for a in ("north", "south", "upper") for b in "abcdefgh") + "]\n"
    short = "COUNTRIES = [\n" + "".join(f'    "{c}",\n' for c in ("Austria", "Belgium", "Croatia", "Denmark", "Estonia", "Finland", "Greece", "Hungary", "Iceland", "Ireland", "Italy", "Latvia", "Malta", "Norway", "Poland")) + "]\n"
    long = words.replace("]\n", "") + "".join(f'    "{a}{b}{c}",\n' for a in "qwerty" for b in ("stone", "field") for c in ("wood", "dale", "ford")) + "]\n"
    assert len(short) < 900 < len(long)
    assert [p3_origin.origin("Python", "a.py", x) for x in (words, short, long)] == [("data", "layout")] * 3
    assert p3_origin.origin("Python", "a.py", 'NAME = "x"\n') is None and p3_origin.origin("Python", "a.py", 'def f(a):\n    return g(a, "some text", "more text")\n' * 20) is None


@pytest.mark.parametrize("language", sorted(p3_origin.BOUNDS))
def test_p3_by_layout_alone(language):
    """What is minified, data or a compiled descriptor is found in every language without its path and comments; ordinary code is not."""
    sign = "#" if language == "Python" else "//"
    packed = "a=[" + ",".join(f"f{i}(b{i},c)" for i in range(400)) + "]\n"
    numbers = "t = [\n" + "".join(f"    {i * 7919 % 65521}, 0x{i:04x}, {i}.5,\n" for i in range(80)) + "]\n"
    words = "t = {\n" + "".join(f'    "name{i}": "some value {i}",\n' for i in range(80)) + "}\n"
    solid = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[i * i % 64] for i in range(900))
    code = "".join(f"    total{i} = merge(total{i - 1}, rows[{i}]);\n    if (total{i} > limit) {{ flush(total{i}, \"done\"); }}\n" for i in range(1, 60))
    kind = lambda text: p3_origin.by_layout(language, text)
    assert (kind(packed), kind(numbers), kind(words), kind(code + f'd = "{solid}"\n')) == ("minified", "data", "data", "generated")
    assert kind(code) is None and kind(f"{sign} Code generated by x. DO NOT EDIT.\n{code}") is None and kind(code + 'u = "https://a.example/' + "b/" * 500 + '"\n') is None and kind("") is None
    assert p3_origin.origin(language, "vendor/a/b.x", code) == ("vendored", "path") and p3_origin.origin(language, "a.x", f"{sign} Code generated by x. DO NOT EDIT.\n{code}") == ("generated", "statement")


def test_jsx_elements():
    whole = 'const A = () => <div className="a" {...p} b={x ? <i/> : null}>hi {name} {/* c */}\n<b>t</b><></></div>;\n'
    assert lexers.first_error("JavaScript", whole, True) is None and lexers.first_error("JavaScript", whole) == (1, "<")
    typed = "export default function X<T>(p: P<T>) { return (\n  <Foo.Bar on={() => { f(1); }}>\n {list.map(x => <li key={x}>{x}</li>)}\n it's text & more\n </Foo.Bar>\n ); }\nconst f = <T,>(x: T) => x;"
    assert lexers.first_error("TypeScript", typed, True) is None
    for bad, line in (("const A = <div>hi</span>;", 1), ("const A = <div>hi;\n", 1), ("const A = () => <div>\n{a b}</div>;", 2), ("const B = <div x=3></div>", 1), ("const A = <div>{f(}</div>;", 1), ("\nconst A = <div>\n{x}\n</div>;\nlet = ;;; )", 5)):
        assert lexers.first_error("JavaScript", bad, True)[0] == line, bad
    assert lexers.first_error("JavaScript", "if (a < b && c > d) { x = a<b; }", True) is None
