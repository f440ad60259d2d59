"""Queries over the whole code graph."""

import heapq
import json
import os

import pytest

from depgraph.functions.exprs import path_cost
from depgraph.plans import catalogue, codegraph

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_components_over_all_relations(spark):
    got = {r["id"]: r["component"] for r in catalogue.QUERIES["connected_components_all"](spark, DATA).collect()}
    up = {r["id"]: r["id"] for r in codegraph._nodes(spark, DATA).select("id").collect()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in codegraph._edges(spark, DATA).select("source_id", "target_id").collect():
        if a in up and b in up:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert got == {x: root(x) for x in up}


def test_paths_over_the_code_graph(spark):
    arcs, want = {}, {}
    for r in codegraph._graph(spark, DATA).arcs.select("src", "dst", path_cost().alias("c")).collect():
        arcs.setdefault(r["src"], []).append((r["dst"], r["c"]))
    for (s,) in codegraph._busiest_source(spark, DATA, 5).collect():
        heap, done = [(0, 0, [s])], set()
        while heap:
            cost, length, path = heapq.heappop(heap)
            if path[-1] not in done:
                done.add(path[-1])
                want[s, path[-1]] = cost, length, ">".join(path)
                for dst, c in arcs.get(path[-1], []):
                    heapq.heappush(heap, (cost + c, length + 1, [*path, dst]))
    assert {(r["source"], r["target"]): (r["cost"], r["length"], r["path"]) for r in catalogue.QUERIES["shortest_paths_code"](spark, DATA).collect()} == want


def own_arcs(spark):
    """Arcs within each repository: {repo: (vertices, {src: [(dst, distance)]})}."""
    from depgraph.functions.exprs import distance

    g = codegraph._graph(spark, DATA)
    repo = {r["id"]: r["repo_id"] for r in g.vertices.collect()}
    out = {}
    for v, r in repo.items():
        out.setdefault(r, (set(), {}))[0].add(v)
    for r in g.arcs.select("src", "dst", distance().alias("d")).collect():
        if repo[r["src"]] == repo[r["dst"]] and r["src"] != r["dst"]:
            out[repo[r["src"]]][1].setdefault(r["src"], []).append((r["dst"], r["d"]))
    return out


def all_shortest(arcs, s):
    """Every cheapest path from s, by target."""
    best, todo = {s: (0, [[s]])}, [(0, [s])]
    heapq.heapify(todo)
    while todo:
        cost, path = heapq.heappop(todo)
        for dst, c in arcs.get(path[-1], []):
            if dst in path:
                continue
            old = best.get(dst)
            if old is None or cost + c < old[0]:
                best[dst] = (cost + c, [[*path, dst]])
            elif cost + c == old[0]:
                best[dst][1].append([*path, dst])
            else:
                continue
            heapq.heappush(todo, (cost + c, [*path, dst]))
    return best


def test_critical_nodes_of_every_repository(spark):
    want = []
    for repo, (ids, arcs) in own_arcs(spark).items():
        score = dict.fromkeys(ids, 0.0)
        for s in ids:
            for t, (cost, paths) in all_shortest(arcs, s).items():
                paths = {tuple(p) for p in paths if sum(dict(arcs[a])[b] for a, b in zip(p, p[1:])) == cost}
                for p in paths:
                    for v in p[1:-1]:
                        score[v] += 1 / len(paths)
        n = len(ids)
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0
        want += [(repo, v, round(x * scale, 6)) for v, x in sorted(((v, x) for v, x in score.items()), key=lambda y: (-round(y[1] * scale, 6), y[0]))[:20]]
    got = {(r["repo_id"], r["id"], r["score"]) for r in catalogue.QUERIES["critical_nodes"](spark, DATA).collect()}
    assert {(r, v, round(x, 5)) for r, v, x in got} == {(r, v, round(x, 5)) for r, v, x in want}


def test_overviews_of_every_repository(spark):
    rows = catalogue.QUERIES["overview_cached"](spark, DATA).collect()
    stats = {r["repo_id"]: r for r in catalogue.QUERIES["repo_stats"](spark, DATA).collect()}
    assert {r["repo_id"] for r in rows} == {k for k, v in stats.items() if v["n_nodes"]}
    for r in rows:
        value = json.loads(r["value_json"])
        assert value["stats"]["node_count"] == stats[r["repo_id"]]["n_nodes"] and len(value["critical"]) <= 20 and all(c["size"] >= 3 for c in value["communities"])
    lines = catalogue.QUERIES["report_markdown"](spark, DATA).where("line = 0").collect()
    assert {r["text"] for r in lines} == {f"# Architecture of {r['repo_id']}" for r in rows}


def test_cycles_of_every_repository(spark):
    from depgraph.operators import algorithms as al
    from depgraph.operators import graph as gr

    nodes = [(f"{r}{i}", r) for r in "pq" for i in range(5)] + [(f"z{i}", "z") for i in range(7)]
    arcs = [("p0", "p1"), ("p1", "p0"), ("p1", "p2"), ("p2", "p0"), ("q0", "q1"), ("q1", "q2"), ("q2", "q3"), ("q3", "q0"), ("p4", "q4"), ("q4", "p4"), ("p3", "p4"), ("z0", "z1"), ("z1", "z0")]
    g = gr.Graph(spark.createDataFrame(nodes, "id string, repo_id string"), spark.createDataFrame(arcs, "src string, dst string"))
    got = [(r["repo_id"], r["place"], tuple(r["nodes"])) for r in al.cycles_by_repo(g, 2, 6).collect()]
    assert sorted(got) == [("p", 1, ("p0", "p1")), ("p", 2, ("p0", "p1", "p2")), ("q", 1, ("q0", "q1", "q2", "q3"))]


def test_joins_on_hot_keys(spark):
    from depgraph.operators.skew import first_per_group, hot_keys, spread_join

    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1), ("none", -2)], "k string, i int")
    unique = spark.createDataFrame([("hot", "h", 1)] + [(f"k{i}", str(i), i) for i in range(0, 300, 3)], "k string, a string, b int")
    hot = hot_keys(rows, "k", 10)
    assert [r[0] for r in hot.collect()] == ["hot"]
    got = {(r["k"], r["i"], r["a"], r["b"]) for r in spread_join(rows, unique, "k", hot).collect()}
    assert got == {("hot" if i % 3 else f"k{i}", i, "h" if i % 3 else str(i), 1 if i % 3 else i) for i in range(300)} | {(None, -1, None, None), ("none", -2, None, None)}
    top = first_per_group(rows, ["k"], ["i"], 4, ["i"]).where("k = 'hot'").orderBy("place").collect()
    assert [(r["place"], r["i"]) for r in top] == [(1, 1), (2, 2), (3, 4), (4, 5)]
    assert hot_keys(rows.where("false"), "k").collect() == []


NODES = "id string, repo_id string, type string, name string, file_path string, language string, docstring string, updated_at timestamp, src string, place int"
EDGES = "id string, repo_id string, source_id string, target_id string, relation string, confidence string, weight double, seq bigint, dst string"


def test_stored_graph(spark, tmp_path):
    from depgraph.operators import graphstore as gs
    from depgraph.operators import search as se

    node = lambda i, name="n", doc=None: (i, "r", "function", name, "f", "go", doc, None, "x", 1)
    edge = lambda a, b, seq: (f"{a}::calls::{b}", "r", a, b, "calls", None, None, seq, "x")
    put = lambda nodes, edges: (spark.createDataFrame(nodes, NODES).write.mode("overwrite").parquet(f"{tmp_path}/nodes.parquet"), spark.createDataFrame(edges, EDGES).write.mode("overwrite").parquet(f"{tmp_path}/edges.parquet"))
    put([], [])
    c = gs.stored(spark, str(tmp_path))
    assert all(df.collect() == [] for df in (c.nodes, c.edges, c.graph.arcs, c.reverse.arcs, c.index.postings, c.ends)) and se.search(c.index, c.nodes, "x").collect() == []
    put([node("a"), node("a", "again"), node("b", None, "Some words"), node(None)], [edge("a", "b", 1), edge("a", "b", 2), edge("a", None, 3), edge("a", "nowhere", 4), (None, *edge("b", "a", 5)[1:])])
    c = gs.stored(spark, str(tmp_path))
    assert c.nodes.count() == 2 and {(r["src"], r["dst"], r["seq"]) for r in c.graph.arcs.collect()} == {("a", "b", 2)} == {(r["src"], r["dst"], r["seq"]) for r in c.reverse.arcs.collect()}
    assert {(r["id"], r["in_degree"], r["out_degree"]) for r in c.ends.collect()} == {("a", 0, 3), ("b", 1, 0)}
    assert [r["id"] for r in se.search(c.index, c.nodes, "word").collect()] == ["b"]
    gone = gs.update_index(c.index, c.nodes.where("id = 'a'"), c.nodes.where("id = 'b'").select("id"))
    assert {r["id"] for r in gone.lengths.collect()} == {"a"} and se.matches(gone, "word").collect() == []


def test_overviews_by_small_plans(spark):
    plan = catalogue.QUERIES["overview_cached"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 12  # the driver holds what all of them broadcast and run at once


def test_lists_of_an_overview(spark):
    from depgraph.operators import graph as gr
    from depgraph.operators import overview as ov

    node = lambda i, repo, kind="function": (i, repo, kind, i.upper(), f"{repo}.py", "python" if kind == "function" else None)
    ids = [f"a{i:02}" for i in range(25)]
    nodes = spark.createDataFrame([*(node(i, "r") for i in ids), node("f", "r", "file"), node("b", "q"), node("n", None)], "id string, repo_id string, type string, name string, file_path string, language string")
    ends = [*((f"a{i:02}", "a24", "calls") for i in range(9)), *(("a24", f"a{i:02}", "calls") for i in range(10, 19)), ("f", "a09", "contains"), ("a24", "b", "calls"), ("a24", "gone", "calls"), ("a24", None, "calls"), ("a09", "a09", None)]
    edges = spark.createDataFrame([("r" if a != "f" else None, a, b, r, "EXTRACTED", i) for i, (a, b, r) in enumerate(ends)], "repo_id string, source_id string, target_id string, relation string, confidence string, seq bigint")
    got = {r["repo_id"]: json.loads(r["value_json"]) for r in ov.overviews(gr.Graph(nodes, gr.collapse(edges)), nodes, edges).collect()}
    assert set(got) == {"r", "q", None} and [got[None]["stats"]["node_count"], got[None]["entry_points"], got[None]["critical"]] == [1, [], []]
    r = got["r"]
    assert r["stats"] == {"node_count": 26, "edge_count": len(ends) - 1, "languages": {"python": 25}, "node_types": {"file": 1, "function": 25}, "relations": {"calls": len(ends) - 2}}
    assert r["critical"][0] == {"id": "a24", "name": "A24", "type": "function", "score": round(9 * 9 / (25 * 24), 6), "method": "betweenness", "in_degree": 9, "out_degree": 9} and [x["id"] for x in r["critical"][1:]] == [i for i in ids if i != "a24"][:19]
    assert [x["id"] for x in r["entry_points"]] == [*ids[:9], *ids[19:24]] and r["entry_points"][0] == {"id": "a00", "name": "A00", "type": "function", "file_path": "r.py", "out_degree": 1}
    assert r["god_objects"] == [{"id": "a24", "name": "A24", "in_degree": 9, "out_degree": 9, "coupling_score": 18, "warning": "A24 is used by 9 and uses 9 others"}]
    assert r["cycles"] == {"found": False, "count": 0, "cycles": []} and r["communities"] == [{"community": "a00", "size": 19, "label": "A00 / A01 / A02", "files": ["r.py"]}]
    assert got["q"]["cycles"] == r["cycles"] and [x["id"] for x in got["q"]["entry_points"]] == ["b"] and got["q"]["stats"]["edge_count"] == 0


def test_first_rows_are_cut_before_they_travel(spark):
    from depgraph.operators.skew import first_rows

    rows = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(300)] + [(None, -1)], "k string, i int")
    top = first_rows(rows, ["k"], ["i"], 3)
    assert sorted((r["k"] or "", r["place"], r["i"]) for r in top.collect()) == [("", 1, -1), ("a", 1, 1), ("a", 2, 2), ("a", 3, 4), ("b", 1, 0), ("b", 2, 3), ("b", 3, 6)]
    plan = top._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "3, Partial" in plan[plan.index("Exchange") :]
