"""Operators on a directed graph of nodes(node) and edges(src, dst).

Loops are driver-side, each round one join and one aggregation; lineage is cut with checkpoint() in the session's folder.
Repeated edges and loops are dropped first.  An empty graph gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the folder that the session names; a local one only in local mode, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(base or "/tmp/sediment-checkpoints")
    return df.checkpoint()


def simple(edges: DataFrame) -> DataFrame:
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree of every node, in one aggregation of both edge ends."""
    e = simple(edges)
    ends = e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(e.select(F.col("src").alias("node"), F.lit(0), F.lit(1))).unionAll(nodes.select("node", F.lit(0), F.lit(0)))
    return ends.where("node IS NOT NULL").groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def neighbors(nodes: DataFrame, edges: DataFrame, head: int | None = None) -> DataFrame:
    """Sorted dependents and dependencies of each node; with ``head`` the first ones and how many more there are."""
    e = simple(edges)
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list("src")).alias("dependents"))
    outs = e.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("dependencies"))
    kind = dict(e.dtypes)["src"]
    none = F.array().cast(f"array<{kind}>")
    out = nodes.select("node").distinct().join(ins, "node", "left").join(outs, "node", "left").select("node", F.coalesce("dependents", none).alias("dependents"), F.coalesce("dependencies", none).alias("dependencies"))
    if head is None:
        return out
    return out.select("node", F.slice("dependents", 1, head).alias("dependents"), F.greatest(F.size("dependents") - head, F.lit(0)).alias("more_dependents"), F.slice("dependencies", 1, head).alias("dependencies"), F.greatest(F.size("dependencies") - head, F.lit(0)).alias("more_dependencies"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).where("in_degree = 0 AND out_degree = 0").select("node")


def entry_points(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Nodes that nothing depends on, by the number of their dependencies."""
    return degrees(nodes, edges).where("in_degree = 0 AND out_degree > 0").orderBy(F.desc("out_degree"), "node").limit(k)


def hubs(nodes: DataFrame, edges: DataFrame, k: int = 15) -> DataFrame:
    return degrees(nodes, edges).where("in_degree > 0").orderBy(F.desc("in_degree"), "node").limit(k)


def node_style(deg: DataFrame, circular: DataFrame) -> DataFrame:
    """Colour and size of each node in a drawing."""
    d = F.col("in_degree")
    color = F.when(F.col("in_cycle"), "red").when(d >= 6, "orange").when(d >= 3, "yellow").when(d >= 1, "green").otherwise("blue")
    flag = circular.select("node").distinct().withColumn("in_cycle", F.lit(True))
    return deg.join(flag, "node", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False))).select("node", color.alias("color"), F.least(F.lit(45), 12 + 4 * d).alias("size"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float = 1e-6, every: int = 10) -> DataFrame:
    """Rank of each node; mass of nodes without edges out is spread evenly; without edges all ranks are equal.

    Stops when the ranks of one round differ by less than n * tolerance in sum; not settling in ``rounds`` is reported by
    falling back to in-degree over n.
    """
    ids = cut(nodes.select("node").where("node IS NOT NULL").distinct())
    n = ids.count()
    if not n:
        return ids.select("node", F.lit(0.0).alias("pagerank"))
    e = simple(edges)
    w = cut(e.join(e.groupBy("src").agg(F.count("*").alias("k")), "src").select("src", "dst", (1.0 / F.col("k")).alias("w")))
    rank, sinks = ids.withColumn("r", F.lit(1.0 / n)), ids.join(w.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    sinks = cut(sinks)
    for i in range(rounds):
        lost = rank.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("lost"))
        flow = w.join(rank, w["src"] == rank["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("w")).alias("x"))
        new = rank.withColumnRenamed("r", "old").join(flow, "node", "left").crossJoin(F.broadcast(lost)).select("node", "old", (alpha * (F.coalesce("x", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("r"))
        new = cut(new)
        settled = new.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] < n * tolerance
        rank = new.select("node", "r")
        if settled:
            return rank.select("node", F.round("r", 6).alias("pagerank"))
    return degrees(ids, e).select("node", F.round(F.col("in_degree") / n, 6).alias("pagerank"))


def pagerank_rounds(nodes: DataFrame, edges: DataFrame, rounds: int, alpha: float = 0.85) -> DataFrame:
    """Rank after a fixed number of rounds."""
    ids = nodes.select("node").where("node IS NOT NULL").distinct()
    n = ids.count()
    e = simple(edges)
    w = cut(e.join(e.groupBy("src").agg(F.count("*").alias("k")), "src").select("src", "dst", (1.0 / F.col("k")).alias("w")))
    out = w.select(F.col("src").alias("node")).distinct().withColumn("has_out", F.lit(True))
    rank = cut(ids.join(out, "node", "left").select("node", F.coalesce("has_out", F.lit(False)).alias("has_out"), F.lit(1.0 / max(n, 1)).alias("r")))
    for i in range(rounds):
        lost = rank.where("NOT has_out").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("lost"))
        flow = w.join(rank, w["src"] == rank["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("w")).alias("x"))
        rank = rank.drop("r").join(flow, "node", "left").crossJoin(F.broadcast(lost)).select("node", "has_out", (alpha * (F.coalesce("x", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("r"))
        if i % 5 == 4:
            rank = cut(rank)
    return rank.select("node", F.round("r", 6).alias("pagerank"))


def _fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str) -> DataFrame:
    """Repeat until no row says it changed; each round's result is checkpointed."""
    while True:
        state = cut(step(state))
        if state.where(changed).isEmpty():
            return state.drop("changed")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that remain when nodes without edges in or out are taken away again and again: all that can lie on a cycle.

    Both ends are peeled at once, two layers for each cut of the lineage, so a graph without cycles is done in a quarter of
    its depth.
    """

    def peel(e: DataFrame) -> DataFrame:
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        return e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")

    e, before = cut(peel(simple(edges))), -1
    while before != (before := e.count()) and before:
        e = cut(peel(peel(e)))
    return e


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its least node): strongly connected components by colouring.

    Nodes that cannot lie on a cycle are components of their own and take no part.  Nodes with edges both ways are merged, which
    is all of most cycles, and what then cannot lie on one drops out again.  Among the rest colours run along edges until each
    node has the least node that reaches it; what reaches the colour's root back within the colour is the root's component;
    the others go round again.
    """
    e = trimmed(edges)
    inside = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    both = cut(e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi"))

    def merge(s: DataFrame) -> DataFrame:
        into = both.join(s.select(F.col("node").alias("src"), F.col("label").alias("c")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
        return s.drop("changed").join(into, "node", "left").select("node", F.least("label", F.coalesce("c", "label")).alias("label"), F.coalesce(F.col("c") < F.col("label"), F.lit(False)).alias("changed"))

    label = _fixpoint(inside.select("node", F.col("node").alias("label"), F.lit(True).alias("changed")), merge, "changed")
    side = lambda s: label.select(F.col("node").alias(s), F.col("label").alias(f"{s}_label"))
    e = trimmed(e.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")))
    merged = _colored(e)
    found = label.join(merged.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    alone = nodes.select("node").where("node IS NOT NULL").distinct().join(label, "node", "left_anti")
    return alone.select("node", F.col("node").alias("component")).unionAll(found)


def _colored(e: DataFrame) -> DataFrame:
    """node, component of the nodes of edges, by colouring."""
    left = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    done = left.select("node", F.col("node").alias("component")).limit(0)
    while not left.isEmpty():

        def spread(s: DataFrame) -> DataFrame:
            into = e.join(s.select(F.col("node").alias("src"), F.col("color").alias("c")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
            return s.drop("changed").join(into, "node", "left").select("node", F.least("color", F.coalesce("c", "color")).alias("color"), F.coalesce(F.col("c") < F.col("color"), F.lit(False)).alias("changed"))

        color = _fixpoint(left.select("node", F.col("node").alias("color"), F.lit(True).alias("changed")), spread, "changed")
        same = e.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        same = cut(same)

        def back(s: DataFrame) -> DataFrame:
            more = same.join(s.where("hit").select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct().withColumn("m", F.lit(True))
            return s.drop("changed").join(more, "node", "left").select("node", "color", (F.col("hit") | F.coalesce("m", F.lit(False))).alias("hit"), (~F.col("hit") & F.coalesce("m", F.lit(False))).alias("changed"))

        hit = _fixpoint(color.select("node", "color", (F.col("node") == F.col("color")).alias("hit"), F.lit(True).alias("changed")), back, "changed")
        found = hit.where("hit").select("node", F.col("color").alias("component"))
        done = done.unionAll(found)
        left = cut(hit.where("NOT hit").select("node"))
        e = cut(e.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi"))
    return done


def circular_nodes(nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Nodes of components of more than one node; the components may be given."""
    c = known if known is not None else components(nodes, edges)
    return c.join(c.groupBy("component").agg(F.count("*").alias("k")).where("k > 1"), "component", "left_semi").select("node")


def elementary(arcs: list[tuple], max_cycles: int) -> Iterator[list]:
    """Elementary cycles of a graph, each from its least node on, by Johnson's blocking: time is linear in their number.

    A node from which the start could not be reached stays blocked until a node behind it comes free, so no dead end is
    searched twice for one start.
    """
    out: dict = {}
    into: dict = {}
    for s, d in sorted(set(arcs)):
        out.setdefault(s, []).append(d)
        into.setdefault(d, []).append(s)

    def reached(start, arcs_of: dict) -> set:
        seen, todo = {start}, [start]
        while todo:
            new = [x for x in arcs_of.get(todo.pop(), ()) if x > start and x not in seen]
            seen.update(new)
            todo += new
        return seen

    n = 0
    for start in sorted(out):
        inside = reached(start, out) & reached(start, into)
        blocked, waiting = {start}, {}
        path, closed = [start], [False]
        stack = [iter(out[start])]
        while stack:
            x = next((x for x in stack[-1] if x == start and len(path) > 1 or x in inside and x not in blocked), None)
            if x == start:
                yield list(path)
                n += 1
                if n >= max_cycles:
                    return
                closed[-1] = True
            elif x is not None:
                path.append(x)
                closed.append(False)
                blocked.add(x)
                stack.append(iter(out.get(x, ())))
            else:
                stack.pop()
                node, hit = path.pop(), closed.pop()
                if hit:
                    free = [node]
                    while free:
                        y = free.pop()
                        if y in blocked:
                            blocked.discard(y)
                            free += waiting.pop(y, ())
                    if closed:
                        closed[-1] = True
                else:
                    for x in out.get(node, ()):
                        if x in inside:
                            waiting.setdefault(x, set()).add(node)


def cycles(nodes: DataFrame, edges: DataFrame, max_cycles: int = 10_000, known: DataFrame | None = None) -> DataFrame:
    """component, nodes, length, complete: elementary cycles of each component, at most ``max_cycles`` of one (their number can be exponential; circular_nodes needs none); complete says whether these are all of the component."""
    c = known if known is not None else cut(components(nodes, edges))
    e = simple(edges)
    inner = e.join(c.select(F.col("node").alias("src"), "component"), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other").select("component", "src", "dst")
    kind = dict(e.dtypes)["src"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(elementary(list(zip(pdf["src"], pdf["dst"])), max_cycles + 1))
        complete = len(found) <= max_cycles
        found = found[:max_cycles]
        return pd.DataFrame({"component": [pdf["component"].iloc[0]] * len(found), "nodes": found, "length": [len(x) for x in found], "complete": [complete] * len(found)})

    return inner.groupBy("component").applyInPandas(run, f"component {kind}, nodes array<{kind}>, length int, complete boolean")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level: longest path from a node that nothing depends on; only for graphs without cycles."""
    e = cut(simple(edges))

    def longer(state: DataFrame) -> DataFrame:
        up = e.join(state.select(F.col("node").alias("src"), "level"), "src").groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("up"))
        return state.join(up, "node", "left").select("node", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"))

    state, before = cut(nodes.select("node").where("node IS NOT NULL").distinct().select("node", F.lit(0).alias("level"))), -1
    while True:
        state = cut(longer(longer(state)))
        total = state.agg(F.coalesce(F.sum("level"), F.lit(0))).first()[0]
        if total == before:
            return state
        before = total


def reading_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """position, node, level: dependencies first; empty if there is a cycle."""
    if not circular_nodes(nodes, edges).isEmpty():
        return nodes.select(F.lit(0).alias("position"), "node", F.lit(0).alias("level")).limit(0)
    ranked = levels(nodes, edges)
    # position without a global window: counts of deeper levels (few rows) plus the place within the level
    per = ranked.groupBy("level").agg(F.count("*").alias("k"))
    before = per.select("level", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("level").orderBy("node")
    return ranked.join(before, "level").select((F.col("before") + F.row_number().over(inner)).cast("bigint").alias("position"), "node", "level")


def transitive_impact(edges: DataFrame) -> DataFrame:
    """node, impacted: how many nodes depend on a node over any path.

    Exact: every pair of a node and what depends on it is made once, so the work is that of the transitive closure.  For graphs
    whose closure is too large, ``transitive_impact_estimate`` keeps a sketch for each node instead.
    """
    e = cut(simple(edges))
    frontier = e.select(F.col("dst").alias("node"), F.col("src").alias("user"))
    found = [frontier]
    while True:
        step = frontier.join(e.select(F.col("dst").alias("user"), F.col("src").alias("next")), "user").select("node", F.col("next").alias("user")).where("node <> user").distinct()
        for seen in found:
            step = step.join(seen, ["node", "user"], "left_anti")
        frontier = cut(step)
        if frontier.isEmpty():
            return reduce(DataFrame.unionAll, found).groupBy("node").agg(F.count("*").alias("impacted"))
        found.append(frontier)


def transitive_impact_estimate(edges: DataFrame, bits: int = 12) -> DataFrame:
    """node, impacted: about how many nodes depend on a node over any path, from one sketch a node (relative error about 1.04 / 2**(bits / 2)).

    Sketches of users flow to what they use until no estimate grows; a node on a cycle counts itself.
    """
    e = cut(simple(edges))
    own = e.select(F.col("dst").alias("node"), "src").groupBy("node").agg(F.hll_sketch_agg("src", bits).alias("s"))
    state, before = cut(own), -1.0
    while True:
        moved = e.join(state.select(F.col("node").alias("src"), "s"), "src").select(F.col("dst").alias("node"), "s")
        state = cut(state.unionByName(moved).groupBy("node").agg(F.hll_union_agg("s").alias("s")))
        total = state.agg(F.coalesce(F.sum(F.hll_sketch_estimate("s")), F.lit(0))).first()[0]
        if total == before:
            return state.select("node", F.hll_sketch_estimate("s").alias("impacted"))
        before = total


def change_impact(nodes: DataFrame, edges: DataFrame, k: int = 8, head: int = 7) -> DataFrame:
    """The direct dependents of the most used nodes, the first ones and how many more."""
    top = hubs(nodes, edges, k)
    e = simple(edges)
    lists = e.join(top.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list("src")).alias("all"))
    return top.join(lists, "node").select("node", "in_degree", F.slice("all", 1, head).alias("dependents"), F.greatest(F.size("all") - head, F.lit(0)).alias("more"))


def sampled(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, ranks: DataFrame, k: int = 300) -> DataFrame:
    """The k nodes to analyse in sampled mode; nodes(node, depth), symbols(node, n_symbols)."""
    deg = degrees(nodes, edges)
    rows = nodes.select("node", "depth").distinct().join(deg, "node").join(ranks, "node", "left").join(symbols, "node", "left")
    return rows.orderBy(F.desc(F.coalesce("pagerank", F.lit(0.0))), F.desc("in_degree"), F.desc(F.coalesce("n_symbols", F.lit(0))), "depth", "node").limit(k).select("node", "pagerank", "in_degree", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))
