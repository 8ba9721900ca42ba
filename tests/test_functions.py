import pytest
from pyspark.sql import functions as F

from sediment.functions import scalar as S
from sediment.operators import manifest as M


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_included(spark):
    cases = [("tool/run.py", 900, True), ("web/app.ts", 2100, True), ("web/node_modules/x/y.js", 90, False), ("tool/__pycache__/run.cpython-313.pyc", 400, False), ("web/package-lock.json", 41000, False), ("tool/tables.py", 160001, False), ("BUILD", 300, False), ("svc/venv/lib/a/b.py", 2500, False), ("cmd/daemon/run.go", 1200, True), (".github/workflows/test.yml", 700, True)]
    cases += [("a.py", 150000, True), ("a.py", 150001, False), ("x.egg-info/a.py", 1, False), ("tool/dist.py", 1, True), ("A.PY", None, True)]
    got = values(spark, [(p, s) for p, s, _ in cases], "path string, size bigint", S.included(F.col("path"), F.col("size")))
    assert [g[0] for g in got] == [k for *_, k in cases]


def test_languages_and_urls(spark):
    got = values(spark, [("tool/rows.py",), ("Panel.tsx",), ("pack.mjs",), ("Containerfile",), ("tool/Run.PY",), (None,)], "path string", S.language(F.col("path")))
    assert [g[0] for g in got] == ["Python", "TypeScript", "JavaScript", "Unknown", "Python", None]
    urls = [("https://host/o/r",), ("https://host/o/r/",), (" host/o/r.git ",), ("https://host/only",), (None,)]
    got = values(spark, urls, "u string", S.repo_parts(F.col("u")))
    assert [tuple(g[0]) if g[0] else None for g in got] == [("o", "r")] * 3 + [None, None]


def test_paths_and_text(spark):
    row = values(spark, [("a/b/../c/./d.py", "One. Two! Three", "x\n  y \nz")], "p string, t string, c string", S.normalized(F.col("p")), S.sentences(F.col("t"), 2), S.lines_between(F.col("c"), F.lit(2), F.lit(9)), S.short_path(F.col("p")), S.parent(F.lit("x.py")))
    assert row == [("a/c/d.py", "One. Two!", "y \nz", "c/./d.py", "")]
    assert values(spark, [("../../a.py",)], "p string", S.normalized(F.col("p"))) == [("a.py",)]


@pytest.mark.parametrize("n,expected", [(5, "Full"), (15, "Full (Warning)"), (25, "Sampled"), (35, "Sampled")])
def test_tiers(spark, n, expected):
    from sediment.config import Limits

    files = spark.createDataFrame([(i, "o/r", f"src/f{i}.py", 10, "s") for i in range(n)] * 2, "file_id bigint, repo string, path string, size_bytes bigint, sha string")
    r = M.analysis_tiers(files, Limits(10, 20, 30)).first()
    assert (r["tier"], r["files_discovered"], r["admitted"]) == (expected, n, n <= 30)
    assert M.capped(files, Limits(10, 20, 30)).count() == min(n, 30)
