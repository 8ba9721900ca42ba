import json
import time
from datetime import datetime

import pytest

from sediment import sinks
from sediment.operators import cache as H
from sediment.operators import reports as R
from sediment.operators import symbols as Y
from sediment.plans import explain as E
from sediment.plans.explain import explain
from sediment.plans.service import Rejected, Request, Service
from sediment.plans.session import Analysis
from sediment.sources import tree
from sediment.streaming import jobs as SJ

A = "from .b import g\n\ndef f(x):\n    return g(x) if x else 0\n"
B = "def g(y):\n    '''Give back.'''\n    return y\n"


@pytest.fixture(scope="module")
def analysis(spark):
    files = spark.createDataFrame([(1, "o/r", "p/a.py", 60, "s1"), (2, "o/r", "p/b.py", 50, "s2"), (2, "o/r", "p/b.py", 50, "s2")], "file_id bigint, repo string, path string, size_bytes bigint, sha string")
    contents = spark.createDataFrame([(1, "o/r", "p/a.py", A), (2, "o/r", "p/b.py", B)], "file_id bigint, repo string, path string, content string")
    return Analysis(spark, files, contents)


def test_analysis(analysis):
    assert [tuple(r) for r in analysis.edges.collect()] == [("o/r", "p/a.py", "p/b.py")]
    got = {r["path"]: (r["risk_level"], r["coupling"], r["max_complexity"]) for r in analysis.scores.collect()}
    assert got == {"p/a.py": ("LOW", 1, 2.0), "p/b.py": ("LOW", 0, 1.0)}
    assert {r["symbol_name"] for r in analysis.chunks.collect()} >= {"f", "g"}
    assert analysis.search("give back", 1).first()["symbol_name"] == "g" and analysis.search(" ").count() == 0
    text = analysis.report()
    assert "not available" not in text and "p/b.py" in text


def test_service(spark, analysis):
    now = datetime(2025, 1, 1)
    log = spark.createDataFrame([("j", "o/r", now, now, "status", None, 100, None)], "job_id string, repo string, ts timestamp_ntz, received_at timestamp_ntz, kind string, phase string, progress int, error string")
    s = Service(spark, log, analysis.files)
    queued = s.submit(Request("https://github.com/o/r.git"), "k", now)
    assert Service(spark, log.unionByName(queued), analysis.files).health()["active"] == 1
    for status, call in ((409, lambda: Service(spark, queued, analysis.files).admit(Request("https://github.com/o/r"))), (422, lambda: s.admit(Request("github.com/o"))), (422, lambda: s.admit(Request("https://github.com/o/r", 101))), (400, lambda: s.admit(Request("github.com/o/none"))), (404, lambda: s.status("none"))):
        with pytest.raises(Rejected) as e:
            call()
        assert e.value.status == status
    assert s.status("j")["status"] == "complete" and s.without("j").count() == 0


def test_cache_and_explanations(spark):
    rows = spark.createDataFrame([("o/r", "a", "o", "r", "s1", "File: a"), ("o/r", "b", "o", "r", "s2", "File: b"), ("o/r", "c", "o", "r", None, "File: c")], "repo string, path string, owner string, repo_name string, sha string, prompt string")
    keys = {r["path"]: r["cache_key"] for r in H.keyed(rows).collect()}
    assert keys["c"] is None
    cache = spark.createDataFrame([(keys["a"], "known"), (keys["b"], "")], "cache_key string, explanation string")
    got = {r["path"]: (r["source"], r["explanation"]) for r in E.explain(rows, cache).collect()}
    assert got == {"a": ("cache", "known"), "b": ("new", "File: b"), "c": ("new", "File: c")}
    calls = []

    def flaky(p):
        calls.append(p)
        raise TimeoutError

    assert E.with_retries(flaky, sleep=lambda s: None)("x") is None and len(calls) == 2
    both = H.upsert(spark.createDataFrame([("k", "old", 1)], "cache_key string, explanation string, cached_at int"), spark.createDataFrame([("k", "new", 2), (None, "x", 3)], "cache_key string, explanation string, cached_at int"))
    assert [tuple(r) for r in both.collect()] == [("k", "new", 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("y")
    (tmp_path / "top.md").write_text("# t")
    assert {tuple(r) for r in tree.local_tree(spark, str(tmp_path)).select("path", "content").collect()} == {("src/a.py", "x = 1\n"), ("top.md", "# t")}
    tree.register(spark)
    listed = tree.blobs(spark.read.format("repo_tree").option("root", str(tmp_path)).load())
    assert {r["path"] for r in listed.collect()} == {"src/a.py", "node_modules/b.js", "top.md"}
    got = tree.fetched(spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, path string"), lambda r, p: p * 2 if p == "a" else None)
    assert [r["content"] for r in got.collect()] == ["aa"]
    with pytest.raises(ValueError):
        tree.metadata(lambda o, n: (404, {}), "o", "n")


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("a",), ("b",)], "node string")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert '"n_edges":1' in sinks.graph_json(n, e).first()["json"] and sinks.graph_html(n, e).count("<circle") == 2 and sinks.graph_html(n, e).count("<line ") == 1 and "1 more files are not shown" in sinks.graph_html(n, e, 1)
    assert sinks.write_text("", str(tmp_path / "x.md")) == "" and sinks.write_text("t", str(tmp_path / "x.md")).endswith("x.md")
    assert "not available" in R.document("T", {"S": lambda: 1 / 0}) and "Nothing" in R.markdown(n.limit(0), "N")


def test_stream(spark, tmp_path):
    now = datetime(2025, 1, 1, 0, 5)
    rows = spark.createDataFrame([("j", "r", now, now, "phase", "docs", 90, None)] * 2 + [("j", "r", now, now, "status", None, 100, None)], SJ.EVENTS)
    rows.write.parquet(str(tmp_path / "in"))
    q = SJ.job_state(SJ.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("state").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["job_id"], r["status"], r["progress"]) for r in spark.table("state").collect()] == [("j", "complete", 100)]


def test_requests_of_other_hosts_are_refused():
    hosts = ("github.com",)
    assert Request("https://www.github.com/o/r/").validate(hosts) == ("o", "r") and Request("git@github.com/o/r.git").validate(hosts) == ("o", "r")
    for url in ("https://other.example/o/r", "https://github.com.evil.example/o/r", "https://github.com//r", "github.com/o", ""):
        with pytest.raises(Rejected) as e:
            Request(url).validate(hosts)
        assert e.value.status == 422
    assert Request("https://code.example/o/r").validate(("code.example",)) == ("o", "r")


def test_parsed_imports_are_flagged(spark):
    files = spark.createDataFrame([(1, "o/r", "app/main.py", 10, "a"), (2, "o/r", "app/store.py", 10, "b"), (3, "o/r", "web/x.js", 10, "c"), (4, "o/r", "app/empty.py", 10, "d")], "file_id bigint, repo string, path string, size_bytes bigint, sha string")
    contents = spark.createDataFrame([(1, "o/r", "app/main.py", "import os\nimport app.store\nfrom . import store\n"), (2, "o/r", "app/store.py", "import json\n"), (3, "o/r", "web/x.js", "import a from './y'\nimport React from 'react'\n"), (4, "o/r", "app/empty.py", "X = 1\n")], "file_id bigint, repo string, path string, content string")
    a = Analysis(spark, files, contents)
    got = {r["file_id"]: [i["is_internal"] for i in r["imports"]] for r in a.symbols.collect()}
    assert got == {1: [False, True, True], 2: [False], 3: [True, False], 4: []}
    assert Y.totals(a.symbols).first()["n_internal_imports"] == 3


def test_paced_calls_share_one_task(spark):
    rows = spark.createDataFrame([("o/r", f"f{i}.py", "o", "r", f"s{i}", f"File: f{i}") for i in range(6)], "repo string, path string, owner string, repo_name string, sha string, prompt string").repartition(4)
    cache = spark.createDataFrame([], "cache_key string, explanation string")
    start = time.time()
    assert explain(rows, cache, lambda p: p + "!", 0.2).count() == 6
    assert time.time() - start >= 1.0


def test_chunk_store(spark, tmp_path):
    chunks = spark.createDataFrame([("o/r", "a", "x"), ("o/r", "b", "y"), ("o/s", "a", "z")], "repo string, chunk_id string, content string")
    place = f"{tmp_path}/stores/j1"
    with pytest.raises(ValueError):
        sinks.open_store(spark, place)
    sinks.store(chunks, place)
    assert sinks.open_store(spark, place).count() == 3
    assert json.loads(sinks.store_info(chunks, "j1").where("repo = 'o/r'").first()["json"])["n_chunks"] == 2
    assert sinks.drop_store(spark, place) and not sinks.drop_store(spark, place)


def test_sampled_mode_restricts_scores_and_chunks(spark, monkeypatch):
    from sediment.config import Limits
    from sediment.plans import session

    monkeypatch.setattr(session, "SAMPLE", 2)
    files = spark.createDataFrame([(i, "o/big", f"p/m{i}.py", 10, "s") for i in range(5)] + [(9, "o/small", "a.py", 10, "s")], "file_id bigint, repo string, path string, size_bytes bigint, sha string")
    contents = spark.createDataFrame([(i, "o/big", f"p/m{i}.py", "from .m0 import f\n\ndef f():\n    return 1\n") for i in range(5)] + [(9, "o/small", "a.py", "def g():\n    return 2\n")], "file_id bigint, repo string, path string, content string")
    a = Analysis(spark, files, contents, limits=Limits(full=2, warning=3, sampled=10))
    assert {r[0] for r in a.scores.select("file_id").collect()} == {0, 1, 9} and {r[0] for r in a.chunks.select("file_id").distinct().collect()} == {0, 1, 9}
    assert Analysis(spark, files, contents).analyzed is None


def test_documents_and_results(spark, analysis):
    f = analysis.facts(explanations=spark.createDataFrame([(2, "It gives back. Twice. And more.")], "file_id bigint, explanation string"))
    row = analysis.results("j1", f).first()
    body = json.loads(row["json"])
    assert body["job_id"] == "j1" and body["branch"] == "main" and body["summary"]["total_import_edges"] == 1 and body["summary"]["files_explained"] == 1
    assert body["reading_order"] == ["p/b.py", "p/a.py"] and body["graph_summary"]["top_files_by_indegree"][0]["path"] == "p/b.py"
    assert "p/b.py: imported by 1" in row["onboarding"] and "It gives back. Twice." in row["file_explanations"] and "And more" not in row["file_explanations"]
    assert row["agent_context"].index("## Overview") < row["agent_context"].index("## Entry points") and "p/a.py: imports 1" in row["agent_context"]
    assert all(len(v) == 2 for v in analysis.smoke().values())
