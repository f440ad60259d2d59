"""Graphs over nodes and edges, bounded traversal and measures by degree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgraph.functions.exprs import weight
from depgraph.sources.shared import kept

STRUCTURAL = ("contains",)


@dataclass
class Graph:
    """vertices: id and whatever describes it; arcs: src, dst, relation, confidence, weight, seq, one per pair."""

    vertices: DataFrame
    arcs: DataFrame

    def stored(self, name: str) -> Graph:
        """The graph written once to the shared folder, for operators that go over it again and again."""
        return Graph(kept(self.vertices, f"{name}-vertices"), kept(self.arcs, f"{name}-arcs"))


def collapse(edges: DataFrame) -> DataFrame:
    """One arc per pair of ends: parallel edges give the attributes of the last one (by seq). Unresolved edges are none."""
    last = F.max_by(F.struct("relation", "confidence", "seq"), "seq")
    arcs = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL").groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(last.alias("r"))
    return arcs.select("src", "dst", "r.relation", "r.confidence", weight("r.confidence").alias("weight"), "r.seq")


def within(arcs: DataFrame, ids: DataFrame) -> DataFrame:
    """Arcs with both ends among the ids."""
    return arcs.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def load_graph(nodes: DataFrame, edges: DataFrame, repo: str | None = None, types: Sequence[str] | None = None, relations: Sequence[str] | None = None) -> Graph:
    """The graph of one repository or of all; nodes and edges hold one row per id.

    Relations are filtered before parallel edges collapse; arcs whose ends aren't vertices are left out.
    """
    if repo is not None:
        nodes, edges = nodes.where(F.col("repo_id") == repo), edges.where(F.col("repo_id") == repo)
    if types is not None:
        nodes = nodes.where(F.col("type").isin(list(types)))
    if relations is not None:
        edges = edges.where(F.col("relation").isin(list(relations)))
    vertices = nodes.select("id", "repo_id", "type", "name", "file_path", "language")
    return Graph(vertices, within(collapse(edges), vertices))


def skipped_edges(graph: Graph, edges: DataFrame) -> DataFrame:
    """Edges that the graph leaves out because an end is missing or unknown, by reason."""
    e = edges.join(graph.vertices.select(F.col("id").alias("source_id"), F.lit(True).alias("has_source")), "source_id", "left").join(graph.vertices.select(F.col("id").alias("target_id"), F.lit(True).alias("has_target")), "target_id", "left")
    reason = F.when(F.col("target_id").isNull(), "unresolved").when(F.col("has_source").isNull(), "unknown source").when(F.col("has_target").isNull(), "unknown target")
    return e.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


# -- traversal -------------------------------------------------------------------------------------------------------
def reach(graph: Graph, start: DataFrame, depth: int, reverse: bool = False, relations: Sequence[str] | None = None) -> DataFrame:
    """Breadth first from one or more start nodes: (start, id, depth, relation, confidence, weight).

    Depth is the least number of steps, from 1; a start that a cycle leads back to is reached like any other
    node. The attributes are those of the arc of least seq by which the node is reached at its depth. start:
    column id, distinct; ids that aren't vertices reach nothing. depth < 1 gives no rows.
    One shuffle per level; the plan is lazy, without an action.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    arcs = graph.arcs if relations is None else graph.arcs.where(F.col("relation").isin(list(relations)))
    arcs = arcs.select(F.col(a).alias("at"), F.col(b).alias("id"), "relation", "confidence", "weight", "seq")
    frontier, seen = start.select(F.col("id").alias("start"), F.col("id").alias("at")), None
    for level in range(1, depth + 1):
        step = frontier.join(arcs, "at").groupBy("start", "id").agg(F.min_by(F.struct("relation", "confidence", "weight"), "seq").alias("r"))
        step = step.select("start", "id", F.lit(level).alias("depth"), "r.relation", "r.confidence", "r.weight")
        if seen is not None:
            step = step.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select("start", F.col("id").alias("at"))
    if seen is None:
        schema = "start string, id string, depth int, relation string, confidence string, weight double"
        return start.sparkSession.createDataFrame([], schema)
    return seen


def dependencies(graph: Graph, start: DataFrame, depth: int = 1, relations: Sequence[str] | None = None) -> DataFrame:
    return reach(graph, start, depth, False, relations).join(graph.vertices.select("id", "name", "type", "file_path"), "id")


def dependents(graph: Graph, start: DataFrame, depth: int = 1, relations: Sequence[str] | None = None) -> DataFrame:
    return reach(graph, start, depth, True, relations).join(graph.vertices.select("id", "name", "type", "file_path"), "id")


def impact(graph: Graph, start: DataFrame, depth: int = 3, relations: Sequence[str] | None = None) -> DataFrame:
    """What a change of the start nodes may break."""
    return dependents(graph, start, depth, relations)


def impact_by_file(affected: DataFrame) -> DataFrame:
    """Affected nodes per file and start: how many, and the least depth."""
    return affected.groupBy("start", "file_path").agg(F.count("*").alias("n"), F.min("depth").alias("depth"))


def ego(graph: Graph, start: DataFrame, radius: int = 2) -> Graph:
    """The induced graph of all nodes at most radius steps from the starts, directions ignored."""
    both = graph.arcs.unionByName(graph.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "confidence", "weight", "seq"))
    near = reach(Graph(graph.vertices, both), start, radius).select("id").unionByName(start.select("id")).distinct()
    vertices = graph.vertices.join(near, "id", "left_semi")
    return Graph(vertices, within(graph.arcs, vertices))


def file_subgraph(graph: Graph, repo: str | Column, path: str | Column) -> Graph:
    """A file's nodes, their neighbours and the arcs among them; empty if the file has no nodes."""
    mine = graph.vertices.where((F.col("repo_id") == repo) & (F.col("file_path") == path)).select("id")
    out = graph.arcs.join(mine.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    into = graph.arcs.join(mine.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    vertices = graph.vertices.join(mine.unionByName(out).unionByName(into).distinct(), "id", "left_semi")
    return Graph(vertices, within(graph.arcs, vertices))


def edges_between(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, direction, relation, confidence) of the arcs between pairs of nodes: -> from a to b, <- from b to a."""
    there = graph.arcs.join(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), ["src", "dst"])
    back = graph.arcs.join(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")).distinct(), ["src", "dst"])
    one = lambda r, a, b, d: r.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(d).alias("direction"), "relation", "confidence")
    return one(there, "src", "dst", "->").unionByName(one(back, "dst", "src", "<-"))


# -- degrees ----------------------------------------------------------------------------------------------------------
def degrees(graph: Graph, structural: Sequence[str] = STRUCTURAL) -> DataFrame:
    """Per vertex: in_degree and out_degree over all arcs, in_plain and out_plain without structural relations."""
    plain = ~F.coalesce(F.col("relation").isin(list(structural)), F.lit(False))
    into = graph.arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"), F.count_if(plain).alias("in_plain"))
    out = graph.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"), F.count_if(plain).alias("out_plain"))
    return graph.vertices.join(into, "id", "left").join(out, "id", "left").na.fill(0, ["in_degree", "in_plain", "out_degree", "out_plain"])


def unused(measured: DataFrame, types: Sequence[str] = ("function", "class")) -> DataFrame:
    """Of the rows of :func:`degrees` those of entry points."""
    return measured.where((F.col("in_plain") == 0) & F.col("type").isin(list(types)))


def overloaded(measured: DataFrame, min_in: int = 8, min_out: int = 8, exclude_out: bool = False) -> DataFrame:
    """Of the rows of :func:`degrees` those of god objects, with the degrees that count, coupling_score and warning."""
    out = F.col("out_plain" if exclude_out else "out_degree")
    warning = F.format_string("%s is used by %d and uses %d others", "name", "in_plain", out)
    return measured.where((F.col("in_plain") >= min_in) & (out >= min_out)).withColumns({"in_degree": F.col("in_plain"), "out_degree": out, "coupling_score": F.col("in_plain") + out, "warning": warning})


def entry_points(graph: Graph, types: Sequence[str] = ("function", "class"), structural: Sequence[str] = STRUCTURAL) -> DataFrame:
    """Vertices that nothing uses (structural arcs aside), with what they use."""
    return unused(degrees(graph, structural), types).select("id", "name", "type", "file_path", "out_degree")


def dead_ends(graph: Graph, types: Sequence[str] = ("function", "class")) -> DataFrame:
    """Vertices that use nothing, with how many use them."""
    return degrees(graph).where((F.col("out_degree") == 0) & F.col("type").isin(list(types))).select("id", "name", "type", "file_path", "in_degree")


def god_objects(graph: Graph, min_in: int = 8, min_out: int = 8, structural: Sequence[str] = STRUCTURAL, exclude_out: bool = False) -> DataFrame:
    """Vertices that many use and that use many themselves. Structural arcs don't count inwards, and outwards only with exclude_out."""
    r = overloaded(degrees(graph, structural), min_in, min_out, exclude_out)
    return r.select("id", "name", "type", "file_path", "in_degree", "out_degree", "coupling_score", "warning")


def critical_by_degree(graph: Graph, top: int = 20) -> DataFrame:
    """The most connected vertices: score is the sum of non-structural arcs; ties by id."""
    d = degrees(graph).withColumn("score", (F.col("in_plain") + F.col("out_plain")).cast("double"))
    return d.orderBy(F.desc("score"), "id").limit(top).select("id", "name", "type", "score", F.col("in_plain").alias("in_degree"), "out_degree")
