"""Overviews of a graph, computed once and kept, and the Markdown report."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.operators import algorithms as al
from depgraph.operators import graph as gr
from depgraph.operators import store as st
from depgraph.operators.skew import first_rows
from depgraph.sources.shared import kept

#: What an overview keeps of each list.
CRITICAL, ENTRIES, GODS, CYCLES, LEAST_COMMUNITY, COMMUNITIES = 20, 20, 10, 20, 3, 30


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def overview(graph: gr.Graph, nodes: DataFrame, edges: DataFrame) -> dict:
    """Counts, critical nodes, entry points, god objects, cycles and communities of one graph; every list is short by definition."""
    count = lambda df, c: {r[c]: r["n"] for r in _rows(st.counts_by(df, c)) if r[c] is not None}
    found = al.cycles(graph, CYCLES, al.SMALL_GRAPH)
    cyc = {"found": None, "count": 0, "cycles": [], "skipped": True, "reason": f"more than {al.SMALL_GRAPH} nodes"} if found is None else None
    if cyc is None:
        rows = _rows(found)
        cyc = {"found": bool(rows), "count": len(rows), "cycles": rows}
    groups = al.communities(graph, LEAST_COMMUNITY)
    return {
        "stats": {"node_count": nodes.count(), "edge_count": edges.count(), "languages": count(nodes, "language"), "node_types": count(nodes, "type"), "relations": count(edges, "relation")},
        "critical": _rows(al.critical_nodes(graph, CRITICAL)),
        "entry_points": _rows(gr.entry_points(graph).orderBy(F.desc("out_degree"), "id").limit(ENTRIES)),
        "god_objects": _rows(gr.god_objects(graph).orderBy(F.desc("coupling_score"), "id").limit(GODS)),
        "cycles": cyc,
        "communities": _rows(al.community_report(graph, groups).orderBy(F.desc("size"), "community").limit(COMMUNITIES).select("community", "size", "label", "files")),
    }


def overviews(graph: gr.Graph, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, metric, value_json): the overview of every repository that has nodes, each a graph of its own, computed for all of them at once.

    The lists are the first rows of each repository, so nothing unbounded is collected anywhere. Cycles of
    repositories with more than SMALL_GRAPH nodes are skipped and their critical nodes go by degree, as in
    :func:`overview`. The arcs and the vertices with their degrees are written once; the rows of all lists and counts
    meet in one aggregation, so no plan gets large. Arcs with an end that is no vertex don't count.
    """
    arcs = kept(al.own_arcs(graph).select("repo_id", "src", "dst", "relation", "confidence", "weight", "seq"), "overviews-arcs")
    v = kept(gr.degrees(gr.Graph(graph.vertices, arcs)), "overviews-vertices")
    g, known = gr.Graph(v, arcs), v.where("repo_id IS NOT NULL")
    # a row per repository and language, type or relation; rows without a repository only count as nodes
    of = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.when(F.col("repo_id").isNotNull(), F.col(c)).alias("key"))
    rows = nodes.select("repo_id", F.inline(F.array(of("languages", "language"), of("node_types", "type"))))
    rows = rows.unionByName(edges.where("repo_id IS NOT NULL").select("repo_id", F.lit("relations").alias("kind"), F.col("relation").alias("key")))
    rows = rows.unionByName(known.select("repo_id", F.lit("vertices").alias("kind"), F.lit(None).cast("string").alias("key")))
    counts = kept(rows.groupBy("repo_id", "kind", "key").agg(F.count("*").alias("n")), "overviews-counts")

    ranked = lambda rows, kind, by: rows.select("repo_id", "id", "name", "type", "file_path", "in_degree", "out_degree", F.lit(kind).alias("kind"), F.col(by).cast("double").alias("score"), *(c for c in ("method", "warning") if c in rows.columns))
    rows = ranked(al.scored_by_repo(g), "critical", "score")
    for others in (ranked(gr.unused(known), "entry_points", "out_degree"), ranked(gr.overloaded(known), "god_objects", "coupling_score")):
        rows = rows.unionByName(others, allowMissingColumns=True)
    first = kept(first_rows(rows, ["repo_id", "kind"], [F.desc("score"), "id"], max(CRITICAL, ENTRIES, GODS)), "overviews-first")

    cyc = kept(al.cycles_by_repo(g, CYCLES).withColumn("kind", F.lit("cycles")), "overviews-cycles")

    members = kept(al.communities(g, LEAST_COMMUNITY, by="repo_id").join(v.select("id", "repo_id", "name", "file_path"), "id"), "overviews-members")
    sizes = members.groupBy("repo_id", "community").agg(F.count("*").alias("size"))
    shown = kept(first_rows(sizes, ["repo_id"], [F.desc("size"), "community"], COMMUNITIES), "overviews-shown")  # COMMUNITIES rows per repository
    shown = shown.join(al.described(members.join(F.broadcast(shown.select("community")), "community", "left_semi")), "community", "left")
    shown = shown.select("repo_id", "place", "community", "size", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.lit("communities").alias("kind"))

    rows = counts
    for part in (first, cyc, shown):
        rows = rows.unionByName(part, allowMissingColumns=True)
    kind = F.col("kind")
    total = lambda k: F.sum(F.when(kind == k, F.col("n")))
    counted = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when((kind == k) & F.col("key").isNotNull(), F.struct("key", "n"))))).alias(k)

    def listed(k, most, *columns):
        all_ = F.array_sort(F.collect_list(F.when((kind == k) & (F.col("place") <= most), F.struct("place", *columns))))
        return F.transform(all_, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(k)

    rows = rows.withColumn("coupling_score", F.col("score").cast("bigint"))
    out = rows.groupBy("repo_id").agg(
        total("languages").alias("node_count"), F.coalesce(total("relations"), F.lit(0)).alias("edge_count"), total("vertices").alias("n_vertices"), *(counted(k) for k in ("languages", "node_types", "relations")),
        listed("critical", CRITICAL, "id", "name", "type", "score", "method", "in_degree", "out_degree"), listed("entry_points", ENTRIES, "id", "name", "type", "file_path", "out_degree"),
        listed("god_objects", GODS, "id", "name", "in_degree", "out_degree", "coupling_score", "warning"), listed("cycles", CYCLES, "length", "nodes"), listed("communities", COMMUNITIES, "community", "size", "label", "files"),
    ).where("node_count > 0")
    skipped = F.col("n_vertices") > al.SMALL_GRAPH
    n = F.size("cycles")
    cycles = F.struct(F.when(~skipped, n > 0).alias("found"), n.alias("count"), F.col("cycles"), F.when(skipped, F.lit(True)).alias("skipped"), F.when(skipped, F.lit(f"more than {al.SMALL_GRAPH} nodes")).alias("reason"))
    stats = F.struct("node_count", "edge_count", "languages", "node_types", "relations")
    value = F.to_json(F.struct(stats.alias("stats"), "critical", "entry_points", "god_objects", cycles.alias("cycles"), "communities"))
    return out.select("repo_id", F.lit("overview").alias("metric"), value.alias("value_json"))


def metrics_table(spark, repo: str, value: dict) -> DataFrame:
    """repo_metrics: one row with the overview as JSON."""
    return spark.createDataFrame([(repo, "overview", json.dumps(value, sort_keys=True, default=str))], "repo_id string, metric string, value_json string").withColumn("computed_at", F.current_timestamp())


def reports(metrics: DataFrame) -> DataFrame:
    """(repo_id, line, text): the Markdown report of every overview in repo_metrics, a row per line."""

    @F.pandas_udf("array<string>")
    def lines(repo: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([report(r, json.loads(v)).split("\n") for r, v in zip(repo, value)])

    rows = metrics.where("metric = 'overview'").select("repo_id", F.posexplode(lines("repo_id", "value_json")).alias("line", "text"))
    return rows.select("repo_id", F.col("line").cast("bigint").alias("line"), "text")


def report(repo: str, value: dict, top: int = 15, max_communities: int = 10) -> str:
    """The overview as Markdown."""
    s = value["stats"]
    pairs = lambda d: ", ".join(f"{k}: {v}" for k, v in sorted(d.items(), key=lambda x: (-x[1], str(x[0])))) or "none"
    out = [f"# Architecture of {repo}", "", f"{s['node_count']} nodes, {s['edge_count']} edges", "", f"Languages: {pairs(s['languages'])}", f"Types: {pairs(s['node_types'])}", f"Relations: {pairs(s['relations'])}", "", "## Critical nodes", ""]
    out += [f"- `{n['name']}` ({n['type']}): score {n['score']:.6f}, in {n['in_degree']}, out {n['out_degree']}" for n in value["critical"][:top]] or ["none"]
    out += ["", "## Entry points", ""] + ([f"- `{n['name']}` in {n['file_path']}: uses {n['out_degree']}" for n in value["entry_points"][:top]] or ["none"])
    out += ["", "## God objects", ""] + ([f"- {n['warning']}" for n in value["god_objects"][:top]] or ["none"])
    c = value["cycles"]
    out += ["", f"## Cycles: {c['count']}", ""] + ([f"- {' > '.join(x['nodes'])}" for x in c["cycles"][:5]] or [c.get("reason", "none")])
    out += ["", "## Communities", ""] + ([f"- {x['label']}: {x['size']} nodes" for x in value["communities"][:max_communities]] or ["none"])
    return "\n".join(out) + "\n"
