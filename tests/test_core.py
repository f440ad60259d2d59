"""The reference's own operators: graph, search, extraction, ingest, streaming and the client's questions."""

import json
import os
import random
import sqlite3
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from depgraph.api import Api
from depgraph.operators import algorithms as al
from depgraph.operators import graph as gr
from depgraph.operators import overview as ov
from depgraph.operators import search as se
from depgraph.operators.extract import SPECS, extract
from depgraph.operators.ingest import Store, ingest
from depgraph.plans import catalogue, golden
from depgraph.sources import files as fi
from depgraph.streaming.ingest import stream_files, stream_pushes

NODE = "id string, repo_id string, type string, name string, file_path string, language string, docstring string"
ARC = "src string, dst string, relation string, confidence string, weight double, seq bigint"
DATA = "/root/testdata/sf0.001"


def make(spark, arcs, confidence=None):
    ids = sorted({x for a in arcs for x in a})
    v = spark.createDataFrame([(i, "r", "function", i, "f", "go", None) for i in ids], NODE)
    rows = [(a, b, "calls", (confidence or {}).get((a, b), "EXTRACTED"), 1.0, n) for n, (a, b) in enumerate(arcs)]
    return gr.Graph(v, spark.createDataFrame(rows, ARC))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_reach_comes_back_to_its_start(spark):
    g = make(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")])
    got = {(r["id"], r["depth"]) for r in gr.dependencies(g, ids(spark, "a"), 2).collect()}
    assert got == {("b", 1), ("a", 2), ("c", 2)}
    assert gr.reach(g, ids(spark, "a"), 0).collect() == []
    assert gr.reach(g, ids(spark, "nowhere"), 3).collect() == []
    assert {r["id"] for r in gr.impact(g, ids(spark, "d"), 3).collect()} == {"a", "b", "c"}


def test_cheapest_path(spark):
    g = make(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], {("a", "c"): "AMBIGUOUS"})
    r = al.shortest_paths(g, ids(spark, "a"), ids(spark, "c", "a")).collect()
    assert {x["target"]: (x["cost"], x["path"]) for x in r} == {"c": (28, ["a", "b", "c"]), "a": (0, ["a"])}
    assert al.shortest_paths(g, ids(spark, "d"), ids(spark, "a")).collect() == []


def test_cycles_components_centrality(spark):
    g = make(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("x", "y")])
    assert [tuple(r["nodes"]) for r in al.cycles(g, 5).collect()] == [("a", "b"), ("a", "b", "c")]
    assert al.cycles(g, 5, max_vertices=2) is None
    assert {r["id"]: r["component"] for r in al.connected_components(g).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    star = make(spark, [("a", "m"), ("m", "b"), ("m", "c")])
    assert {r["id"]: r["score"] for r in al.betweenness(star).collect()} == {"a": 0.0, "b": 0.0, "c": 0.0, "m": round(2 / 6, 6)}
    with pytest.raises(ValueError):
        al.betweenness(star, max_vertices=2)


def test_communities_beat_components(spark):
    k = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(5) if i != j]
    g = make(spark, [*k("a"), *k("b"), ("a0", "b0")])
    c = al.communities(g, 2)
    groups = {}
    for r in c.collect():
        groups.setdefault(r["community"], set()).add(r["id"][0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"]]
    whole = al.connected_components(g).withColumnRenamed("component", "community")
    assert al.modularity(g, c) > al.modularity(g, whole)


def test_communities_until_nothing_merges(spark):
    g = make(spark, [(f"v{i:03}", f"v{i + 1:03}") for i in range(23)])
    c = {r["id"]: r["community"] for r in al.communities(g, 1).collect()}
    line = [c[f"v{i:03}"] for i in range(24)]
    degree = lambda i: 1 if i in (0, 23) else 2
    inside = lambda x: sum(degree(i) for i in range(24) if line[i] == x)
    assert set(c) == {f"v{i:03}" for i in range(24)}
    for x, y in {(a, b) for a, b in zip(line, line[1:]) if a != b}:
        links = sum({a, b} == {x, y} for a, b in zip(line, line[1:]))
        assert links / 23 <= 2 * inside(x) * inside(y) / (2 * 23) ** 2 + al.EPSILON  # merging the two gains nothing


def test_communities_in_blocks(spark):
    k = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(6) for j in range(i)]
    arcs = [*k("a"), *k("b"), *k("c"), *k("d"), ("a0", "b0"), ("b1", "c1"), ("c2", "d2"), ("d3", "a3")]
    g = make(spark, arcs)
    c = al.communities(g, 1)
    assert {(r["id"][0], r["community"]) for r in c.collect()} == {(p, f"{p}0") for p in "abcd"}
    mixed = g.vertices.withColumn("repo_id", F.substring("id", 2, 1)).withColumn("file_path", F.col("id"))  # blocks across the groups
    c = al.communities(gr.Graph(mixed, g.arcs), 1, block=40)
    assert c.count() == c.select("id").distinct().count() == 24 and al.modularity(g, c) > 0.5  # 0.69 at best
    alone = al.communities(gr.Graph(g.vertices.withColumn("repo_id", F.substring("id", 2, 1)), g.arcs), 2, by="repo_id", block=3)
    assert {(r["id"][1], r["community"][1]) for r in alone.collect()} <= {(i, i) for i in "0123"}


def test_communities_take_few_rounds(spark, monkeypatch):
    steps = []
    real = al.checkpointed
    monkeypatch.setattr(al, "checkpointed", lambda df, replaces=None: steps.append(1) or real(df, replaces))
    g = make(spark, [(f"v{i:03}", f"v{i + 1:03}") for i in range(200)])
    c = al.communities(g, 1)
    assert c.count() == 201 and len(steps) <= 8  # each writes files, of whatever size


def test_betweenness_of_all_pivots_together():
    draw = random.Random(5)
    for n in (3, 7, 12):
        arcs = sorted({(a, b) for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(4 * n)) if a != b})
        cost = np.array([draw.choice([4, 5, 7, 10]) for _ in arcs])
        heads, tails = np.array(arcs).T
        want = np.zeros(n)
        for part in al._brandes(n, heads, tails, cost, np.arange(n))(iter([pd.DataFrame({"pivot": range(n)})])):
            want[part["id"]] = part["part"]
        start, all_ = np.searchsorted(heads, np.arange(n + 1)), np.arange(n)
        assert np.allclose(al._through(start, tails, cost, 0 * all_, 0 * all_ + n, all_), want)


def test_cycles_by_repo_take_few_rounds(spark, monkeypatch):
    steps = []
    real = al.checkpointed
    monkeypatch.setattr(al, "checkpointed", lambda df, replaces=None: steps.append(1) or real(df, replaces))
    g = make(spark, [*((f"v{i:02}", f"v{(i + 1) % 30:02}") for i in range(30)), ("v01", "v00"), ("x", "y"), ("y", "z")])
    found = [(r["place"], r["length"], r["nodes"][0]) for r in al.cycles_by_repo(g).orderBy("place").collect()]
    assert found == [(1, 2, "v00"), (2, 30, "v00")] and len(steps) <= 3
    assert al.cycles_by_repo(make(spark, [("a", "b")])).collect() == []


def test_search_ranks_like_fts5(spark):
    rows = [("1", "r", "class", "ParseTree", "src/tree.py", "python", "Walks the tree quickly"), ("2", "r", "function", "walk_tree", "src/walk.py", "python", "tree walk walk"), ("3", "q", "function", "other", "lib/x.go", "go", None), ("4", "r", "function", "Café", "a/b.c", "c", "the tree walks"), ("5", "r", "class", "z", "z", "c", ""), ("6", "r", "class", "q", "q", "c", "tree of the walk")]
    nodes = spark.createDataFrame(rows, NODE)
    index = se.build_index(nodes)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(name, docstring, file_path, tokenize='unicode61')")
    db.executemany("INSERT INTO f(rowid, name, docstring, file_path) VALUES (?, ?, ?, ?)", [(int(r[0]), r[3], r[6], r[4]) for r in rows])
    for q, match in (("walk", '"walk"*'), ("the tree", '"the tree"'), ("cafe", '"cafe"*'), ("tr", '"tr"*')):
        want = {str(i): round(s, 9) for i, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
        assert {r["id"]: round(r["rank"], 9) for r in se.ranked(index, q).collect()} == want
    assert se.search(index, nodes, '"::"').collect() == []
    assert [r["id"] for r in se.search(index, nodes, "tree", 20, "class", "r").collect()] and se.resolve_node(index, nodes, "r", "3").collect() == []


def test_exclusion(spark):
    paths = ["vendor/x.php", "oms/public/js/app.js", "src/app.min.js", "a/migrations/m.php", "build/x.py", "mybuild/x.py", "x.unknown", "A.PY", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    out = {r["p"]: (r["x"], r["s"], r["l"]) for r in df.select("p", fi.excluded("p", [*fi.DEFAULT_EXCLUDES, "**/migrations/**"]).alias("x"), fi.suffix_excluded("p").alias("s"), fi.language_of("p").alias("l")).collect()}
    assert [p for p, v in out.items() if v[0]] == ["vendor/x.php", "oms/public/js/app.js", "a/migrations/m.php", "build/x.py"]
    assert out["src/app.min.js"][1] and out["A.PY"][2] == "python" and out["x.unknown"][2] is None and out[None] == (False, False, None)


SOURCES = {language: (path, text) for language, path, text in reversed(golden.SOURCES)}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_extraction(language):
    path, text = SOURCES[language]
    assert language == "python" or language in SPECS
    nodes, edges, error = extract("r", path, language, text)
    assert error is None
    names = {n["name"] for n in nodes}
    assert "A" in names and "Z" not in names and any(n.split("::")[-1] == "m" for n in names) and any(n.split("::")[-1] == "helper" for n in names) and "inner" not in names
    assert any(e["relation"] == "calls" and e["src"].endswith("m") and (e["tgt"] or "").endswith("helper") for e in edges)
    assert len({n["id"] for n in nodes}) == len(nodes)


@pytest.mark.parametrize("path", [s[1] for s in golden.SOURCES])
def test_extraction_of_golden_sources(path):
    language, _, text = next(s for s in golden.SOURCES if s[1] == path)
    nodes, edges, error = extract("r", path, language, text)
    assert error is None
    assert ["|".join([path, n["type"], n["name"], str(n["line_start"]), str(n["line_end"]), n["docstring"] or "", " ".join(n["decorators"])]) for n in nodes] == ["|".join(r) for r in golden.rows(golden.NODES) if r[0] == path]
    want = [r for r in golden.rows(golden.EDGES) if r[0].split("::")[0] == path]
    assert [[e["src"][3:], e["relation"], (e["tgt"] or "r::")[3:], e["tgt_name"] or "", e["confidence"], str(e["line"])] for e in edges] == want


def test_extraction_takes_time_in_proportion():
    def took(n):
        text = "\n".join(f"/** Doc {i}. */\nfunction f{i}(a) {{ return g{i}(a); }}" for i in range(n))
        began = time.process_time()
        assert len(extract("r", "b.js", "javascript", text)[0]) == n + 1
        return time.process_time() - began

    took(500)
    assert took(8000) < 16 * took(1000) + 0.3


def test_extraction_details():
    _, e, _ = extract("r", *("a.php", "php"), SOURCES["php"][1])
    assert {(x["relation"], x["tgt_name"]) for x in e if x["tgt"] is None} == {("imports", "User"), ("inherits", "B"), ("implements", "C"), ("implements", "D"), ("calls", "User")}
    n, e, _ = extract("r", "a.py", "python", SOURCES["python"][1])
    assert ("imports_from", "lib.x") in {(x["relation"], x["tgt_name"]) for x in e} and [x["decorators"] for x in n if x["name"] == "A::m"] == [["@wraps"]]
    assert ("INFERRED", "helper") in {(x["confidence"], x["tgt_name"]) for x in e}  # it calls itself
    assert extract("r", "b.py", "python", "def (")[2].startswith("SyntaxError") and extract("r", "b.go", "go", "")[0][0]["type"] == "file"


FILE = "repo_id string, file_path string, language string, content string, file_hash string"


def files(spark, d):
    return spark.createDataFrame([("r", p, "python", t, str(hash(t))) for p, t in d.items()], FILE)


def test_incremental_equals_full(spark, tmp_path):
    v1 = {"a.py": "def a():\n    return b()\n", "b.py": "def b():\n    return c()\n", "c.py": "def c():\n    pass\n"}
    v2 = {"a.py": v1["a.py"], "b.py": "def b2():\n    pass\n", "d.py": "def b():\n    return a()\n"}
    step, full = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "f"))
    assert ingest(step, files(spark, v1))["indexed"] == 3
    r = ingest(step, files(spark, v2))
    assert (r["indexed"], r["skipped"], r["removed"]) == (2, 1, 1)
    ingest(full, files(spark, v2))
    same = lambda t, *c: sorted(step.table(t).select(*c).collect()) == sorted(full.table(t).select(*c).collect())
    assert same("nodes", "id", "line_start") and same("edges", "id", "confidence") and same("files", "file_path", "file_hash")
    assert ("r::a.py::a::calls::r::d.py::b",) in {tuple(x) for x in step.table("edges").select("id").collect()}
    assert ingest(step, files(spark, v2))["indexed"] == 0
    bad = ingest(step, files(spark, v2 | {"a.py": "def ("}))
    assert bad["errors"] == 1 and bad["nodes"] == r["nodes"]  # the old rows stay
    assert ingest(step, files(spark, v2), force=True)["indexed"] == 3


def test_stream_and_questions(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def a():\n    '''Adds things.'''\n    return b()\n")
    (root / "b.py").write_text("def b():\n    return 1\n")
    run = lambda: stream_files(spark, str(root), "repo", str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    run()
    (root / "c.py").write_text("def c():\n    return a()\n")
    run()
    store = Store(spark, str(tmp_path / "store"))
    assert {r["id"] for r in store.table("edges").where("relation = 'calls'").select("id").collect()} == {"repo::a.py::a::calls::repo::b.py::b", "repo::c.py::c::calls::repo::a.py::a"}
    nodes = store.table("nodes").withColumn("ord", F.monotonically_increasing_id())
    edges = store.table("edges").withColumn("seq", F.monotonically_increasing_id()).withColumn("weight", F.lit(1.0))
    repos = spark.createDataFrame([("repo", "Repo", "ready", None)], "id string, name string, status string, last_indexed timestamp")
    api = Api(repos, nodes, edges)
    assert json.loads(api.query("repo", "adds"))["results"][0]["name"] == "a"
    assert json.loads(api.impact("repo", "repo::b.py::b", 2))["total_affected"] == 4  # with the files that contain them
    assert json.loads(api.path("repo", "repo::c.py::c", "repo::b.py::b"))["length"] == 2
    assert "error" in json.loads(api.query("repo", " ")) and "error" in json.loads(api.impact("repo", "a", 9)) and "error" in json.loads(api.path("nope", "a", "b"))
    assert json.loads(api.dependencies("repo", "c", 1, "out"))["dependencies"]["total"] == 1
    assert json.loads(api.list_repos())["repos"][0]["n_nodes"] == 6


def test_pushes_rebuild_their_repositories(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.py").write_text("def a(): pass\n")
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "1.json").write_text('{"repository": "One", "ref": "main"}\n{"repository": "r1", "ref": "dev"}\n{"repository": "nobody", "ref": "main"}\n')
    repos = spark.createDataFrame([("r1", "One", str(tmp_path / "one")), ("r2", "Two", str(tmp_path / "two"))], "id string, name string, path string")
    stream_pushes(spark, str(tmp_path / "events"), repos, lambda i, p: fi.scan(spark, p, i), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    assert {r["id"] for r in Store(spark, str(tmp_path / "store")).table("nodes").select("id").collect()} == {"r1::a.py", "r1::a.py::a"}


def test_signed_pushes(spark):
    import hashlib
    import hmac

    from depgraph.streaming.ingest import verified_pushes

    sign = lambda text, key: "sha256=" + hmac.new(key.encode(), text.encode(), hashlib.sha256).hexdigest()
    body = json.dumps({"repository": {"name": "One"}, "ref": "main"})
    for key in ("secret", "x" * 100):
        rows = [("push", sign(body, key), body), ("push", sign(body, "other"), body), ("ping", sign(body, key), body), ("push", sign("no json", key), "no json"), ("push", None, body), (None, None, None)]
        got = verified_pushes(spark.createDataFrame(rows, "event string, signature string, payload string"), key).collect()
        assert [(r["repository"], r["ref"]) for r in got] == [("One", "main")]


def test_store_keeps_other_repositories(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    mine = lambda repo, d: files(spark, d).withColumn("repo_id", F.lit(repo))
    assert ingest(store, mine("1", {"a.py": "def a(): pass\n"}))["indexed"] == 1
    ingest(store, mine("2", {"b.py": "def b():\n    return c()\n\ndef c(): pass\n"}), metrics=True)
    first = {r["repo_id"]: r["v"] for r in store.manifest().collect()}
    ingest(store, mine("2", {"b.py": "def b(): pass\n"}))
    second = {r["repo_id"]: r["v"] for r in store.manifest().collect()}
    assert set(first) == set(second) == {"1", "2"} and first["1"] == second["1"] and first["2"] != second["2"]
    assert {r["id"] for r in store.table("nodes").collect()} == {"1::a.py", "1::a.py::a", "2::b.py", "2::b.py::b"}
    assert {(r["id"], r["status"], r["node_count"]) for r in store.table("repos").collect()} == {("1", "ready", 2), ("2", "ready", 2)}
    assert [(r["repo_id"], r["metric"]) for r in store.table("repo_metrics").collect()] == [("2", "overview")]
    want = {tuple(r) for r in se.build_index(store.table("nodes")).postings.select("id", "col", "pos", "term").collect()}
    assert {tuple(r) for r in store.table("postings").select("id", "col", "pos", "term").collect()} == want
    ingest(store, mine("2", {"b.py": "def d(): pass\n"}))
    ingest(store, mine("2", {"b.py": "def e(): pass\n"}))
    assert len(store.versions()) == 2 and store.table("nodes").where("repo_id = '1'").count() == 2
    assert ingest(store, mine("2", {}))["indexed"] == 0


def test_command_line(spark, tmp_path, capsys):
    from depgraph.__main__ import main

    (tmp_path / "shop").mkdir()
    (tmp_path / "shop" / "a.py").write_text("def alpha():\n    return beta()\n\ndef beta(): pass\n")
    store = ["--store", str(tmp_path / "store")]
    assert main([*store, "index", str(tmp_path / "shop")], spark) == 0 and main([*store, "search", "shop", "alph"], spark) == 0
    assert '"name": "alpha"' in capsys.readouterr().out
    assert main([*store, "overview", "shop"], spark) == 0 and '"node_count": 3' in capsys.readouterr().out
    assert main([*store, "index", str(tmp_path / "nowhere")], spark) == 1


def test_overview_and_report(spark):
    k = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(4) if i != j]
    g = make(spark, [*k("a"), *k("b"), ("a0", "b0")])
    e = g.arcs.select("src", "relation")
    value = ov.overview(g, g.vertices, e)
    assert value["cycles"]["count"] == 20 and len(value["communities"]) == 2 and value["stats"]["relations"] == {"calls": 25}
    text = ov.report("r", value)
    assert "## Cycles: 20" in text and "8 nodes, 25 edges" in text and "a0 > a1" in text


def test_config(tmp_path):
    assert fi.load_config(str(tmp_path)).name == tmp_path.name
    (tmp_path / ".depgraph.yml").write_text("name: shop\nexclude: [gen, '**/migrations/**']\nlanguages: php\n")
    c = fi.load_config(str(tmp_path))
    assert (c.name, c.exclude, c.languages) == ("shop", ["gen", "**/migrations/**"], [])
    (tmp_path / ".depgraph.yml").write_text("a: [\n")
    assert fi.load_config(str(tmp_path)).name == tmp_path.name


def same(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


CHECKED = sorted(catalogue.SQL)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = catalogue.QUERIES[name](spark, DATA)
    cur = con.execute(catalogue.SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert sorted(repr([same(v) for v in r]) for r in df.collect()) == sorted(repr([same(r[i]) for i in at]) for r in cur.fetchall())
