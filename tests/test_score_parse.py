import pytest
from pyspark.sql import functions as F

from sediment.operators import chunks as K
from sediment.operators import context as X
from sediment.operators import jobs as J
from sediment.operators import retrieve as T
from sediment.operators import score as C
from sediment.parsing import driver as P

BASE = {"avg": 1.0, "max": 1.0, "coupling": 0, "undocumented": 0.0, "n_functions": 5, "parse_error": False, "in_cycle": False, "lines": 50}
RISK = [({"parse_error": True}, "CRITICAL"), ({"in_cycle": True}, "CRITICAL"), ({"max": 21.0}, "CRITICAL"), ({"max": 20.0}, "HIGH"), ({"avg": 10.0}, "HIGH"), ({"max": 11.0}, "HIGH"), ({"coupling": 8}, "HIGH"), ({"undocumented": 0.8, "n_functions": 4}, "HIGH"), ({"lines": 600}, "HIGH"), ({"undocumented": 0.99, "n_functions": 2}, "LOW"), ({"avg": 6.0}, "MEDIUM"), ({"coupling": 4}, "MEDIUM"), ({"lines": 300}, "MEDIUM"), ({}, "LOW"), ({"avg": 6.0, "coupling": 4}, "MEDIUM"), ({"avg": 10.0, "coupling": 4}, "HIGH"), ({"max": None, "parse_error": None}, "LOW")]


def test_risk(spark):
    rows = [tuple((BASE | o).values()) for o, _ in RISK]
    df = spark.createDataFrame(rows, "avg double, max double, coupling int, undocumented double, n_functions int, parse_error boolean, in_cycle boolean, lines int")
    level, reasons = C.risk()
    got = df.select(level.alias("l"), reasons.alias("r")).collect()
    assert [g["l"] for g in got] == [x for _, x in RISK]
    assert got[13]["r"] == [] and len(got[14]["r"]) == 2 and len(got[15]["r"]) == 1


PY = '''"""Module."""
import os, sys
from ..models import User as U, *
@deco
async def f(a, b: int = 1, *args, c, **kw):
    """Doc."""
    for x in a:
        if x and b:
            pass
class K(Base, m.Other, metaclass=M):
    def g(self):
        return 1 if self else 2
'''


def test_python_symbols():
    s = P.parse_text(PY.replace(", *\n", "\n"), "Python")
    f, g = s["functions"]
    assert s["module_docstring"] == "Module." and [i["module"] for i in s["imports"]] == ["os, sys", "..models"] and s["imports"][1]["names"] == ["User"]
    assert f["name"] == "f" and f["params"] == ["a", "b", "*args", "c", "**kw"] and f["is_async"] and f["line_start"] == 5 and f["docstring"] == "Doc." and not f["is_method"]
    assert g["is_method"] and s["classes"][0]["bases"] == ["Base", "m.Other"] and s["classes"][0]["method_names"] == ["g"]
    assert s["complexity"] == {"f": 4, "K.g": 2}
    bad = P.parse_text("def ok():\n    pass\ndef broken(:\n", "Python")
    assert bad["parse_error"] and bad["functions"][0]["name"] == "ok"
    assert P.parse_text("", "Python")["functions"] == []


def test_brace_symbols():
    js = P.parse_text("import D, { a as b } from './m';\nimport * as N from 'n';\nexport async function f(x, ...r) { if (x && r) { return 1; } }\nconst g = (y) => { return y ? 1 : 2; };\nclass A extends B.C { m(p) { for (;;) {} } }\n", "JavaScript")
    assert [(f["name"], f["params"], f["is_async"], f["is_method"]) for f in js["functions"]] == [("f", ["x", "...r"], True, False), ("g", ["y"], False, False), ("m", ["p"], False, True)]
    assert js["classes"][0]["bases"] == ["B.C"] and js["complexity"] == {"f": 3, "g": 2, "m": 2}
    assert [(i["module"], i["names"]) for i in js["imports"]] == [("./m", ["D", "a"]), ("n", ["* as N"])]
    go = P.parse_text('package p\nimport (\n"fmt"\n"x.example/y"\n)\ntype S struct { a int }\nfunc (s *S) Setup(msg string) error {\n\tif msg == "" || s == nil {\n\t\treturn nil\n\t}\n\treturn nil\n}\n', "Go")
    assert [i["module"] for i in go["imports"]] == ["fmt", "x.example/y"] and go["functions"][0]["params"] == ["msg"] and go["complexity"] == {"Setup": 3} and go["classes"][0]["name"] == "S"
    rs = P.parse_text("use std::collections::HashMap;\nuse crate::u::{helper, logger};\nstruct P { a: u8 }\ntrait T { fn t(&self); }\nimpl P {\n fn init(&self, x: u8) -> u8 { match x { 1 => 2, _ => 3 } }\n}\nfn top() {}\n", "Rust")
    assert [i["names"] for i in rs["imports"]] == [["HashMap"], ["helper", "logger"]] and {f["name"]: f["is_method"] for f in rs["functions"]} == {"init": True, "top": False} and rs["classes"][0]["method_names"] == ["init"]
    java = P.parse_text("import a.b.C;\nclass X extends Y implements Z {\n  int run(long id, String payload) { if (id > 0 && payload != null) { return 1; } return 0; }\n}\n", "Java")
    assert java["functions"][0]["params"] == ["id", "payload"] and java["functions"][0]["is_method"] and java["classes"][0]["bases"] == ["Y", "Z"] and java["complexity"] == {"run": 3}
    cpp = P.parse_text('#include <v>\n#include "w.h"\nclass A : public B {\n void calculate() { while (1) {} }\n int dispatch(int q);\n};\nint main(int argc) { return argc ? 1 : 0; }\n', "C++")
    assert [i["module"] for i in cpp["imports"]] == ["<v>", '"w.h"'] and cpp["classes"][0]["method_names"] == ["calculate", "dispatch"] and {f["name"] for f in cpp["functions"]} == {"calculate", "main"}


def test_chunks(spark):
    sym = "file_id bigint, repo string, path string, language string, module_docstring string, functions array<struct<name:string,line_start:int,line_end:int>>, classes array<struct<name:string,line_start:int,line_end:int>>, imports array<struct<module:string,names:array<string>,is_from_import:boolean>>, parse_error boolean"
    symbols = spark.createDataFrame([(1, "r", "a/b.py", None, "Doc", [("f", 3, 4)], [("K", 1, 99)], [("m", ["x", "y"], True), ("os", [], False)], None), (2, "r", "c.py", None, None, [], [], [], False), (3, "r", "d.py", None, "D", [], [], [], True)], sym)
    contents = spark.createDataFrame([(1, "class K:\n  pass\n  def f():\n    return 1\n"), (2, "x"), (3, "y"), (1, "class K:\n  pass\n  def f():\n    return 1\n")], "file_id bigint, content string")
    got = {r["symbol_type"]: r for r in K.make_chunks(contents, symbols).collect()}
    assert set(got) == {"module", "function", "class"}
    assert got["module"]["content"] == '# MODULE: a/b.py\n"""Doc"""\n\nfrom m import x, y\nimport os'
    assert got["function"]["content"] == "# f (a/b.py)\ndef f():\n    return 1" and got["function"]["chunk_id"] == "a_b_py::f::3::function"
    assert got["class"]["line_end"] == 16
    back = K.from_sentinels(K.to_sentinels(spark.createDataFrame([(None, None), (3.0, "LOW")], "complexity double, risk_level string")))
    assert [tuple(r) for r in back.collect()] == [(None, None), (3.0, "LOW")]


def test_context_and_search(spark):
    rows = [(1, "r", "a.py", "c", "class", "z" * 100, None, 9), (2, "r", "a.py", "f", "function", "f" * 7000, 5.0, 1), (3, "r", "a.py", "m", "module", "m" * 500, None, 1), (4, "r", "a.py", "g", "function", "g" * 2000, 2.0, 5), (5, "r", "b.py", "m", "module", None, None, 1)]
    b = {r["chunk_no"]: r for r in X.budgeted(spark.createDataFrame(rows * 2, "chunk_no bigint, repo string, file_path string, symbol_name string, symbol_type string, content string, complexity double, line_start int")).collect()}
    assert [(b[i]["position"], b[i]["fate"], b[i]["kept_chars"]) for i in (3, 2, 4, 1)] == [(1, "full", 500), (2, "full", 7000), (3, "cut", 500), (4, "dropped", 0)]
    v = spark.createDataFrame([(1, [1.0, 0.0], "Go"), (2, [0.0, 1.0], "Go"), (3, [1.0, 1.0], "C"), (4, [0.0, 0.0], "C"), (5, None, "C")], "chunk_id bigint, embedding array<float>, language string")
    assert [r["chunk_id"] for r in T.nearest(v, [1.0, 0.1], 2).collect()] == [1, 3]
    assert [r["chunk_id"] for r in T.nearest(v, [1.0, 0.1], 2, T.where(language="Go")).collect()] == [1, 2]
    assert T.nearest(v, [0.0, 0.0]).count() == 0 and T.where() is None
    many = T.nearest_of_many(v, v.where("chunk_id <= 3"), 2, key="chunk_id")
    assert {(r["query_id"], r["chunk_id"]) for r in many.where("rank = 1").collect()} == {(1, 3), (2, 3), (3, 1)}


def test_jobs(spark):
    from datetime import datetime as D

    at = lambda m: D(2025, 1, 1, 0, m)
    log = [("a", "r", at(0), at(0), "status", None, 0, None), ("b", "r", at(1), at(1), "status", None, 0, None), ("b", "r", at(2), at(2), "phase", "parsing", 20, None), ("c", "s", at(1), at(1), "phase", "graph", 35, None), ("c", "s", at(2), at(2), "error", "graph", None, ""), ("d", None, at(3), at(3), "status", None, 100, None)]
    df = spark.createDataFrame(log * 2, "job_id string, repo string, ts timestamp_ntz, received_at timestamp_ntz, kind string, phase string, progress int, error string")
    got = {r["job_id"]: (r["status"], r["error"]) for r in J.latest(df).collect()}
    assert got == {"a": ("queued", None), "b": ("running", None), "c": ("failed", "unknown error"), "d": ("complete", None)}
    assert [tuple(r) for r in J.active_per_repo(df).collect()] == [("r", 2)]
    assert J.latest(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["risk_distribution", "make_chunks", "parse_symbols", "vector_topk", "job_progress"])
def test_queries_on_the_smallest_tables(spark, name):
    from sediment import queries

    assert queries.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1


def test_given_chunks_are_rebuilt(spark):
    d = "/root/testdata/sf0.001"
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    mine = K.make_chunks(t("contents"), t("symbols").withColumn("parse_error", F.lit(False))).select("file_id", "symbol_type", "line_start", F.col("content").alias("mine"), "symbol_name").where("symbol_type = 'function'")
    both = t("chunks").where("symbol_type = 'function'").dropDuplicates(["chunk_no"]).join(mine, ["file_id", "symbol_type", "line_start", "symbol_name"])
    assert both.count() > 50 and both.where("mine = content").count() / both.count() > 0.95


def test_imports_in_comments_and_literals_do_not_count():
    """An import inside a comment, a template or a literal of several lines is none."""
    cases = [
        ("JavaScript", "/*\nimport a from 'x'\n*/\nconst t = `\nimport b from 'y'\n`;\n// import c from 'w'\nimport d from 'z'\n", ["z"]),
        ("Go", "package p\n/*\nimport \"x\"\n*/\nimport (\n\t\"a\"\n\t// \"c\"\n\t\"b\"\n)\nvar s = `\nimport \"y\"\n`\n", ["a", "b"]),
        ("Java", '/* \nimport a.B;\n*/\nimport c.D;\nclass X { String s = """\nimport e.F;\n"""; }\n', ["c"]),
        ("Rust", 'use a::b;\n/*\nuse c::d;\n*/\nfn f() { let s = r#"\nuse e::f;\n"#; }\n', ["a"]),
        ("C", "/*\n#include <a.h>\n*/\n#include <b.h>\n#include \"c.h\"\n", ["<b.h>", '"c.h"']),
    ]
    for language, text, modules in cases:
        assert [i["module"] for i in P.parse_text(text, language)["imports"]] == modules, language


def test_default_labels():
    java = "class A { int f(int x) { switch (x) { case 1: return 1; case 2: return 2; default: return 3; } } }"
    assert P.parse_text(java, "Java")["complexity"] == {"f": 4}
    assert P.parse_text("class B { public: B() { x = 1; } void g() = default; int h(int x) { switch (x) { case 1: return 1; default: return 2; } } };", "C++")["complexity"]["h"] == 3
