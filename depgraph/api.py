"""The eight questions a client may ask, answered as JSON. Every answer is a JSON object; problems come as {"error": ...}."""

from __future__ import annotations

import functools
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.functions.exprs import weight
from depgraph.operators import algorithms as al
from depgraph.operators import graph as gr
from depgraph.operators import overview as ov
from depgraph.operators import search as se
from depgraph.operators import store as st
from depgraph.operators.ingest import Store, ingest
from depgraph.sources.files import load_config, scan


def _tool(f):
    @functools.wraps(f)
    def run(*a, **k) -> str:
        try:
            return json.dumps(f(*a, **k), indent=2, default=str)
        except Exception as e:
            return json.dumps({"error": str(e) or type(e).__name__})

    return run


def _within(name: str, value: int, low: int, high: int) -> int:
    if not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def _text(name: str, value: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must not be empty")
    return value.strip()


class Api:
    """repos, nodes and edges are the stored tables, one row per id."""

    def __init__(self, repos: DataFrame, nodes: DataFrame, edges: DataFrame, metrics: DataFrame | None = None, index: se.Index | None = None):
        self.repos, self.nodes, self.edges, self.metrics = repos, nodes, edges, metrics
        self.index = index or se.build_index(nodes)

    @classmethod
    def of(cls, store: Store) -> Api:
        """The questions put to a store, with the search index and the metrics that ingests keep."""
        if store.version() is None:
            raise ValueError(f"nothing is stored in {store.folder}")
        edges = store.table("edges").withColumn("weight", weight()).withColumn("seq", F.xxhash64("seq"))
        return cls(store.table("repos"), store.table("nodes"), edges, store.table("repo_metrics"), se.Index(store.table("postings"), store.table("lengths")))

    def _graph(self, repo: str) -> gr.Graph:
        if st.get_repo(self.repos, repo).isEmpty():
            raise ValueError(f"unknown repository {repo}")
        return gr.load_graph(self.nodes, self.edges, repo)

    def _node(self, repo: str, name: str) -> DataFrame:
        found = se.resolve_node(self.index, self.nodes, repo, _text("node", name))
        if found.isEmpty():
            raise ValueError(f"no node like {name}")
        return found

    @_tool
    def list_repos(self):
        r = st.repo_stats(self.repos, self.nodes, self.edges).join(st.recent_repos(self.repos).select(F.col("id").alias("repo_id"), "place"), "repo_id")
        return {"repos": [x.asDict(True) for x in r.orderBy("place").drop("place").collect()]}

    @_tool
    def build(self, store: Store, path: str, force: bool = False):
        if not os.path.isdir(_text("path", path)):
            raise ValueError(f"no folder {path}")
        config = load_config(path)
        repos = store.spark.createDataFrame([(config.name, config.name, os.path.abspath(path))], "id string, name string, path string")
        return ingest(store, scan(store.spark, path, config.name, config.exclude), force, repos=repos, metrics=True)

    @_tool
    def query(self, repo: str, query: str, node_type: str | None = None, limit: int = 20):
        rows = se.search(self.index, self.nodes, _text("query", query), _within("limit", limit, 1, 50), node_type, repo).collect()
        return {"query": query, "repo_id": repo, "count": len(rows), "results": [r.asDict() for r in rows]}

    @_tool
    def dependencies(self, repo: str, node: str, depth: int = 1, direction: str = "both"):
        g, start, out = self._graph(repo), self._node(repo, node), {}
        _within("depth", depth, 1, 5)
        for key, reverse, wanted in (("dependencies", False, ("out", "both")), ("dependents", True, ("in", "both"))):
            if direction in wanted:
                rows = (gr.dependents if reverse else gr.dependencies)(g, start, depth).orderBy("depth", "name", "id").collect()
                out[key] = {"total": len(rows), key: [r.asDict() for r in rows]}
        return out

    @_tool
    def impact(self, repo: str, node: str, depth: int = 3):
        rows = gr.impact(self._graph(repo), self._node(repo, node), _within("depth", depth, 1, 5)).orderBy("depth", "id").collect()
        files: dict[str, list] = {}
        for r in rows:
            files.setdefault(r["file_path"], []).append(r.asDict())
        return {"total_affected": len(rows), "affected_files": len(files), "by_file": files}

    @_tool
    def path(self, repo: str, source: str, target: str):
        g = self._graph(repo).stored("path")
        rows = al.shortest_paths(g, self._node(repo, source), self._node(repo, target)).collect()
        return {"found": True, "path": rows[0]["path"], "length": rows[0]["length"], "cost": rows[0]["cost"] / 14} if rows else {"found": False, "reason": "no path"}

    @_tool
    def overview(self, repo: str, top_n: int = 10):
        _within("top_n", top_n, 1, 50)
        kept = None if self.metrics is None else self.metrics.where((F.col("repo_id") == repo) & (F.col("metric") == "overview")).orderBy(F.desc("computed_at")).limit(1).collect()
        value = json.loads(kept[0]["value_json"]) if kept else self._overview(repo)
        return {k: v[:top_n] if isinstance(v, list) else v for k, v in value.items()}

    def _overview(self, repo: str) -> dict:
        mine = lambda df: df.where(F.col("repo_id") == repo)
        return ov.overview(self._graph(repo).stored("overview"), mine(self.nodes), mine(self.edges))

    @_tool
    def sync_kb(self, repo: str, top_n: int = 15, max_communities: int = 10):
        return {"repo_id": repo, "markdown": ov.report(repo, self._overview(repo), _within("top_n", top_n, 5, 50), _within("max_communities", max_communities, 1, 30))}
