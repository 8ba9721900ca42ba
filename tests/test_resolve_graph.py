import itertools
import random

import pytest
from pyspark.sql import functions as F

from sediment.operators import graph as G
from sediment.operators import resolve as V

IMPORT = "file_id bigint, ord int, repo string, path string, language string, module string, names array<string>, is_internal boolean"
CASES = [
    ("pkg/jobs/loader.py", "Python", "pkg.net.client", [], ["pkg/net/client.py", "pkg/conf.py"], {"pkg/net/client.py"}),
    ("pkg/jobs/loader.py", "Python", "pkg.net", [], ["pkg/net/__init__.py"], {"pkg/net/__init__.py"}),
    ("pkg/jobs/loader.py", "Python", "numpy", [], ["pkg/conf.py"], set()),
    ("pkg/jobs/loader.py", "Python", ".conf", ["K"], ["pkg/conf.py", "pkg/jobs/loader.py"], {"pkg/conf.py"}),
    ("pkg/jobs/loader.py", "Python", "..conf", ["K"], ["pkg/conf.py"], {"pkg/conf.py"}),
    ("pkg/jobs/loader.py", "Python", ".", ["queue", "timer"], ["pkg/jobs/queue.py", "pkg/jobs/timer.py"], {"pkg/jobs/queue.py", "pkg/jobs/timer.py"}),
    ("pkg/jobs/loader.py", "Python", ".", ["*"], ["pkg/conf.py"], set()),
    ("pkg/jobs/loader.py", "Python", "a, b", [], ["a.py", "b.py"], {"a.py", "b.py"}),
    ("web/lib/main.ts", "TypeScript", "./text.ts", [], ["web/lib/text.ts"], {"web/lib/text.ts"}),
    ("web/lib/main.ts", "TypeScript", "./text", [], ["web/lib/text.ts"], {"web/lib/text.ts"}),
    ("web/views/Shell.tsx", "TypeScript", "./Panel", [], ["web/views/Panel/index.tsx"], {"web/views/Panel/index.tsx"}),
    ("web/lib/text.ts", "TypeScript", "../conf", [], ["web/conf.ts"], {"web/conf.ts"}),
    ("web/Shell.tsx", "TypeScript", "svelte", [], ["web/conf.ts"], set()),
    ("a.go", "Go", "x.example/b", [], ["b.go"], set()),
]


def test_resolution(spark):
    imports = [(i, 0, f"r{i}", p, lang, m, names, True) for i, (p, lang, m, names, _, _) in enumerate(CASES)]
    files = [(f"r{i}", f) for i, c in enumerate(CASES) for f in c[4]]
    got = V.resolved(spark.createDataFrame(imports * 2, IMPORT), spark.createDataFrame(files, "repo string, path string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["repo"], set()).add(r["target"])
    assert [by.get(f"r{i}", set()) for i in range(len(CASES))] == [c[5] for c in CASES]


def test_internal(spark):
    rows = [("Go", "code.example/org/tool/store", ["store/disk.go"], True), ("Go", "code.example/org/tool/stor", ["store/disk.go"], True), ("Go", "code.example/org/tool/disk", ["store/disk.go"], False), ("Go", "sort", ["sort/x.go"], False)]
    rows += [("Go", "code.example/org/dep", ["third/code.example/org/deps/a.go"], True), ("Go", "example/dep.v2", ["third/code.example/dep.v2/a.go"], False), ("Go", "a.example/x", ["old-a.example/xy/z.go"], True), ("Go", "yaml.v3", ["lib/yaml.v3.go"], True), ("Go", "yaml.v3", ["lib/yaml.go"], False)]
    rows += [("Rust", "crate::store", [], True), ("Rust", "core::mem", [], False), ("Java", "org.sample.rows", ["org/sample/rows/R.java"], True), ("Java", "org.sample.ro", ["org/sample/rows/R.java"], True), ("Java", "sample.rows", ["org/sample/rows/R.java"], False), ("Java", "java.time", ["x.java"], False)]
    rows += [("C", '"ring.h"', [], True), ("C", "<math.h>", [], False), ("JavaScript", "./a", [], True), ("Python", "a.b", ["a/b.py"], True)]
    imports = spark.createDataFrame([(i, 0, f"r{i}", "p", lang, m, [], None) for i, (lang, m, _, _) in enumerate(rows)], IMPORT)
    files = spark.createDataFrame([(f"r{i}", f) for i, r in enumerate(rows) for f in [*r[2], "z.txt"]], "repo string, path string")
    got = {r["file_id"]: r["internal"] for r in V.is_internal(imports, files).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3] for r in rows]


def make(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges or [], "src string, dst string")


def test_graph_cases(spark):
    n, e = make(spark, "abc", [("a", "b"), ("c", "b"), ("a", "a"), ("a", "b")])
    assert {tuple(r) for r in G.degrees(n, e).collect()} == {("a", 0, 1), ("b", 2, 0), ("c", 0, 1)}
    n, e = make(spark, "abc", [("a", "b"), ("b", "c")])
    assert [r["node"] for r in G.reading_order(n, e).orderBy("position").collect()] == ["c", "b", "a"]
    n, e = make(spark, "abc", [("a", "b"), ("b", "a")])
    assert {r["node"] for r in G.circular_nodes(n, e).collect()} == {"a", "b"}
    assert [r["nodes"] for r in G.cycles(n, e).collect()] == [["a", "b"]]
    assert G.reading_order(n, e).count() == 0 and [r["node"] for r in G.isolated(n, e).collect()] == ["c"]
    n, e = make(spark, "x", [])
    assert G.pagerank(n, e).first()["pagerank"] == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_against_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [chr(97 + i) for i in range(9)]
    edges = list({(rng.choice(nodes), rng.choice(nodes)) for _ in range(16)})
    n, e = make(spark, nodes, edges)
    reach = {(a, b) for a, b in edges if a != b}
    while True:
        more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
        if not more:
            break
        reach |= more
    expected = {x: min([y for y in nodes if (x, y) in reach and (y, x) in reach] + [x]) for x in nodes}
    assert {r["node"]: r["component"] for r in G.components(n, e).collect()} == expected
    found = {tuple(r["nodes"]) for r in G.cycles(n, e).collect()}
    arcs = {(a, b) for a, b in edges if a != b}
    brute = {p for k in range(2, 8) for p in itertools.permutations(nodes, k) if p[0] == min(p) and all(x in arcs for x in zip(p, p[1:] + p[:1]))}
    assert {f for f in found if len(f) < 8} == brute
    assert abs(sum(r["pagerank"] for r in G.pagerank(n, e).collect()) - 1) < 1e-4
    impact = {r["node"]: r["impacted"] for r in G.transitive_impact(e).collect()}
    assert impact == {y: k for y in nodes if (k := sum(1 for x in nodes if x != y and (x, y) in reach))}


def test_empty_graph(spark):
    n, e = make(spark, [], [])
    assert G.degrees(n, e).count() == G.components(n, e).count() == G.levels(n, e).count() == G.transitive_impact(e).count() == 0
    assert G.pagerank(n, e).count() == 0 and n.select(F.count("*")).first()[0] == 0


def test_cycles_say_whether_they_are_all(spark):
    n, e = make(spark, "abcde", [(a, b) for a in "abc" for b in "abc" if a != b] + [("d", "e"), ("e", "d")])
    for bound, whole in ((5, {"a": 5, "d": 1}), (4, {"d": 1})):
        got = G.cycles(n, e, bound).collect()
        assert len(got) == bound + 1 and {c: sum(r["component"] == c for r in got) for c in {r["component"] for r in got if r["complete"]}} == whole


def file_graph(n):
    arcs = {(i, i // k) for i in range(n) for k in (2, 3)} | {(i // 2, i) for i in range(n) if i % 32 == 7} | {(i // 4, i) for i in range(n) if i % 64 == 13 and i % 32 != 7}
    return {(a, b) for a, b in arcs if a != b}


def test_file_graph(spark, tmp_path):
    from sediment import queries as Q

    n = 600
    files = spark.createDataFrame([(i, "r", f"src/f{i}.py", 10, None) for i in range(n)], "file_id bigint, repo string, path string, size_bytes bigint, sha string")
    files.write.parquet(f"{tmp_path}/files.parquet")
    q, d = Q.queries(), str(tmp_path)
    arcs = file_graph(n)
    assert {tuple(r) for r in Q.file_links(spark, d).collect()} == arcs
    out = {}
    for a, b in arcs:
        out.setdefault(a, set()).add(b)
    reach = {}
    for i in range(n):
        seen, todo = set(), [i]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        reach[i] = seen
    component = {i: min([i, *[j for j in reach[i] if i in reach[j]]]) for i in range(n)}
    assert {r["node"]: r["component"] for r in q["file_components"](spark, d).collect()} == component
    circular = {i for i in range(n) if i in reach[i]}
    assert circular and {r["node"] for r in q["file_circular_nodes"](spark, d).collect()} == circular
    brute = set()
    for i in circular:
        todo = [[i]]
        while todo:
            path = todo.pop()
            for x in out[path[-1]]:
                if x == i:
                    brute.add(",".join(map(str, path)))
                elif x > i and x not in path and component[x] == component[i]:
                    todo.append([*path, x])
    assert {r["nodes"] for r in q["file_cycles"](spark, d).collect()} == brute
    rank = dict.fromkeys(range(n), 1 / n)
    for _ in range(Q.ROUNDS):
        new = dict.fromkeys(range(n), 0.15 / n + 0.85 * sum(rank[i] for i in range(n) if i not in out) / n)
        for a, b in arcs:
            new[b] += 0.85 * rank[a] / len(out[a])
        rank = new
    got = {r["node"]: r["pagerank"] for r in q["file_pagerank_rounds"](spark, d).collect()}
    assert len(got) == n and all(abs(got[i] - rank[i]) < 2e-6 for i in range(n))
    settled = {r["node"]: r["pagerank"] for r in q["file_pagerank"](spark, d).collect()}
    assert len(settled) == n and all(abs(settled[i] - rank[i]) < 1e-3 for i in range(n))
    into = {i: sorted(a for a, b in arcs if b == i) for i in range(n)}
    top = sorted(range(n), key=lambda i: (-len(into[i]), i))[:15]
    assert [r["node"] for r in q["file_hubs"](spark, d).collect()] == top
    assert {(r["node"], r["dependents"], r["more"]) for r in q["file_change_impact"](spark, d).collect()} == {(i, ",".join(map(str, into[i][:7])), max(len(into[i]) - 7, 0)) for i in top[:8]}
    assert q["file_graph_summary"](spark, d).first().asDict() == {"n_nodes": n, "n_edges": len(arcs), "n_circular": len(circular)}
    style = {r["node"]: r["color"] for r in q["file_node_style"](spark, d).collect()}
    assert {i for i, c in style.items() if c == "red"} == circular


def test_cycles_by_brute_force():
    """All elementary cycles, each once, also where dead ends are many."""
    rng = random.Random(4)

    def brute(arcs):
        out, found = {}, set()
        for a, b in arcs:
            out.setdefault(a, []).append(b)

        def go(p):
            for x in out.get(p[-1], ()):
                if x == p[0]:
                    found.add(tuple(p))
                elif x > p[0] and x not in p:
                    go([*p, x])

        for a in out:
            go([a])
        return found

    for _ in range(200):
        n = rng.randint(2, 7)
        arcs = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < rng.choice([0.2, 0.4])]
        got = [tuple(c) for c in G.elementary(arcs, 10**9)]
        assert len(got) == len(set(got)) and set(got) == brute(arcs)
    diamonds = [x for i in range(60) for x in ((4 * i, 4 * i + 1), (4 * i, 4 * i + 2), (4 * i + 1, 4 * i + 3), (4 * i + 2, 4 * i + 3), (4 * i + 3, 4 * i + 4))]
    assert len(list(G.elementary([*diamonds, (1, 0), (240, 999), (999, 240)], 5))) == 2


def test_trimmed_and_estimate(spark):
    chain = [(i, i + 1) for i in range(40)] + [(50, 51), (51, 52), (52, 50), (40, 50), (52, 60)]
    e = spark.createDataFrame(chain, "src bigint, dst bigint")
    assert sorted(map(tuple, G.trimmed(e).collect())) == [(50, 51), (51, 52), (52, 50)]
    assert G.trimmed(e.where("src < 40")).isEmpty() and G.trimmed(e.limit(0)).isEmpty()
    acyclic = e.where("NOT (src = 52 AND dst = 50)")
    exact = {r[0]: r[1] for r in G.transitive_impact(acyclic).collect()}
    assert {r[0]: r[1] for r in G.transitive_impact_estimate(acyclic).collect()} == exact and exact[60] == 44
    assert G.transitive_impact_estimate(e.limit(0)).isEmpty() and G.transitive_impact(e.limit(0)).isEmpty()
