"""Paths, components, cycles, centrality and communities."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.functions.exprs import distance, path_cost
from depgraph.operators import graph as gr
from depgraph.operators.graph import Graph, critical_by_degree, within
from depgraph.operators.skew import first_rows, hot_keys, spread_join
from depgraph.sources.shared import checkpointed

#: Above so many vertices, centrality is by degree and cycles are skipped; so many pivots stand for all sources at most.
SMALL_GRAPH, PIVOTS = 5_000, 500
#: A rise in modularity that counts, and the rounds of local moving without one after which a level ends.
EPSILON, PATIENCE = 1e-4, 3
#: Links that one task moves the ends of; a gain that counts, as a share of a graph's weight; if a level leaves so many of its vertices, the next one is done for all at once.
BLOCK, LEAST_GAIN, STUCK = 250_000, 1e-12, 0.95
#: For betweenness: arcs times pivots of a part, rows for a task, and vertices as seen from pivots that are held at once.
WORK, SLOT, PLACES = 4_000_000, 100_000, 4_000_000


def shortest_paths(graph: Graph, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Cheapest paths from every source: (source, target, cost, length, path).

    A step costs 1 / max(weight, 0.01), times 14, so costs are whole numbers; of equally cheap paths the one
    with fewest steps counts, then the least in order of its ids. A source reaches itself by the path of
    itself. Only nodes whose cost fell in the last round go into the next; a round is a join with the arcs,
    and its result is checkpointed.
    """
    arcs = graph.arcs.select(F.col("src").alias("at"), F.col("dst").alias("next"), path_cost().alias("step"))
    starts = sources.join(graph.vertices.select("id"), "id", "left_semi")
    best = starts.select(F.col("id").alias("source"), F.col("id").alias("target"), F.struct(F.lit(0).alias("cost"), F.lit(0).alias("length"), F.array("id").alias("path")).alias("p"), F.lit(True).alias("new"))
    best = checkpointed(best)
    while not best.where("new").isEmpty():
        step = best.where("new").join(arcs, F.col("target") == F.col("at"))
        step = step.select("source", F.col("next").alias("target"), F.struct((F.col("p.cost") + F.col("step")).alias("cost"), (F.col("p.length") + 1).alias("length"), F.concat("p.path", F.array("next")).alias("path")).alias("p"), F.lit(True).alias("fresh"))
        merged = best.select("source", "target", "p", F.lit(False).alias("fresh")).unionByName(step).groupBy("source", "target").agg(F.min("p").alias("p"), F.min(F.when(~F.col("fresh"), F.col("p"))).alias("old"))
        best = checkpointed(merged.select("source", "target", "p", (F.col("old").isNull() | (F.col("p") < F.col("old"))).alias("new")), best)
    r = best if targets is None else best.join(targets.select(F.col("id").alias("target")), "target", "left_semi")
    return r.select("source", "target", "p.cost", "p.length", "p.path")


def connected_components(graph: Graph) -> DataFrame:
    """(id, component) of every vertex, directions ignored; a component is named by its least id.

    Labels spread to neighbours, and each round also takes over the label of one's label (pointer jumping), so
    rounds grow with the logarithm of a component's width. Vertices with many arcs and labels that many
    vertices have are joined by broadcast (at most HOT of them), so no task gets all rows of one.
    """
    both = graph.arcs.select("src", "dst").unionByName(graph.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = checkpointed(both)
    hubs = checkpointed(hot_keys(both, "src"))
    labels = checkpointed(graph.vertices.select("id", F.col("id").alias("component")))
    while True:
        near = spread_join(both, labels.select(F.col("id").alias("src"), "component"), "src", hubs).groupBy("dst").agg(F.min("component").alias("near"))
        step = checkpointed(labels.join(near, F.col("id") == F.col("dst"), "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("next")))
        common = hot_keys(step, "next")
        jump = spread_join(step, labels.select(F.col("id").alias("next"), F.col("component").alias("beyond")), "next", common)
        label = F.least("next", F.coalesce("beyond", "next"))
        step = checkpointed(jump.select("id", label.alias("label"), (label < F.col("component")).alias("moved")))
        labels = step.select("id", F.col("label").alias("component"))
        if step.where("moved").isEmpty():
            return labels


def _on_cycles(arcs: DataFrame) -> tuple[DataFrame, int]:
    """The arcs between vertices that have arcs in and out among what is left, until nothing more is trimmed, and their number."""
    arcs = checkpointed(arcs.where("src <> dst").distinct())
    n = arcs.count()
    while n:
        trimmed = checkpointed(within(arcs, arcs.select(F.col("src").alias("id")).intersect(arcs.select(F.col("dst").alias("id")))))
        if (m := trimmed.count()) == n:
            break
        arcs, n = trimmed, m
    return arcs, n


def _cycles_of(arcs: list[tuple[str, str]], limit: int) -> list[list[str]]:
    """The ``limit`` shortest elementary cycles of one graph, each from its least vertex on, ties in order of their vertices.

    A path grows over larger vertices than its first, and only where the way back is short enough.
    """
    out, into = defaultdict(set), defaultdict(set)
    for a, b in arcs:
        if a != b:
            out[a].add(b)
            into[b].add(a)
    loose = [x for x in {*out, *into} if not out[x] or not into[x]]
    while loose:  # what lies on no cycle
        x = loose.pop()
        for near, far in ((out, into), (into, out)):
            for y in near.pop(x, ()):
                far[y].discard(x)
                if not far[y] and near.get(y):
                    loose.append(y)
    found, more = [], []

    def back(first):
        steps, level = {first: 0}, [first]
        while level:
            level = [y for x in level for y in into[x] if y > first and y not in steps and steps.setdefault(y, steps[x] + 1)]
        return steps

    def closed(first, length, again):
        steps, longer, stack, path = back(first), False, [iter(sorted(out[first]))], [first]
        while stack:
            for x in stack[-1]:
                if x in steps and x != first and x not in path:
                    if len(path) + steps[x] > length:
                        longer = True
                    elif len(path) + 1 == length:
                        if steps[x] == 1:
                            yield [*path, x]
                        longer = True  # it may go on elsewhere
                    else:
                        path.append(x)
                        stack.append(iter(sorted(out[x])))
                        break
            else:
                stack.pop()
                path.pop()
        if longer:
            again.append(first)

    for first in sorted(x for x in out if out[x] and into.get(x)):
        steps = back(first)
        if ways := [1 + steps[x] for x in out[first] if x in steps]:
            more.append((min(ways), first))
    length = 2
    while more and len(found) < limit:
        length = max(length, min(n for n, _ in more))
        again: list[str] = []
        now = [f for n, f in more if n <= length]
        found += heapq.nsmallest(limit - len(found), (c for f in now for c in closed(f, length, again)))
        length += 1
        more = [(n, f) for n, f in more if n >= length] + [(length, f) for f in again]
    return found


def cycles_by_repo(graph: Graph, limit: int = 20, max_vertices: int = SMALL_GRAPH) -> DataFrame:
    """(repo_id, place, length, nodes): the cycles of :func:`cycles` in every repository of at most max_vertices vertices, each repository a graph of its own and done by one task, as its size is bounded."""
    small = graph.vertices.groupBy("repo_id").agg(F.count("*").alias("n")).where(F.col("n") <= max_vertices).select("repo_id")  # a row per repository
    arcs = own_arcs(graph).where("src <> dst").join(F.broadcast(small), "repo_id", "left_semi").select("repo_id", "src", "dst")
    arcs = arcs if "repo_id" in graph.arcs.columns else checkpointed(arcs)
    slots = max(arcs.sparkSession.sparkContext.defaultParallelism, arcs.count() // SLOT)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        all_ = [(repo, i + 1, len(c), c) for repo, x in rows.groupby("repo_id") for i, c in enumerate(_cycles_of([*zip(x["src"], x["dst"])], limit))]
        return pd.DataFrame(all_, columns=["repo_id", "place", "length", "nodes"])

    slotted = arcs.withColumn("slot", F.pmod(F.xxhash64("repo_id"), F.lit(slots))).repartition(slots, "slot")
    return slotted.groupBy("slot").applyInPandas(run, "repo_id string, place int, length int, nodes array<string>")


def cycles(graph: Graph, limit: int = 20, max_vertices: int | None = None, max_length: int | None = None) -> DataFrame | None:
    """The ``limit`` shortest elementary cycles: (length, nodes), each from its least id on, ties in order of ids; with max_vertices, None above it.

    First what lies on no cycle is trimmed away. Then simple paths grow one arc a round from every vertex
    over larger ids only, so each cycle comes up once, at its length; no round follows once there are enough.
    """
    if max_vertices is not None and graph.vertices.limit(max_vertices + 1).count() > max_vertices:
        return None
    arcs, n = _on_cycles(graph.arcs.select("src", "dst"))
    found = arcs.sparkSession.createDataFrame([], "length int, nodes array<string>")
    paths, have, length = arcs.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("nodes")), 0, 2
    while have < limit and (max_length is None or length <= max_length):
        ends = arcs.select(F.col("src").alias("last"), F.col("dst").alias("first"), F.lit(True).alias("closes"))
        paths = checkpointed(paths.join(ends, ["last", "first"], "left"))
        n_paths, n_closed = paths.agg(F.count("*"), F.count("closes")).first()
        if not n_paths:
            break
        if n_closed:
            found = found.unionByName(paths.where("closes").select(F.lit(length).alias("length"), "nodes").orderBy("nodes").limit(limit))
            have += n_closed
        grown = paths.join(arcs, F.col("last") == F.col("src")).where((F.col("dst") > F.col("first")) & ~F.array_contains("nodes", F.col("dst")))
        paths = grown.select("first", F.col("dst").alias("last"), F.concat("nodes", F.array("dst")).alias("nodes"))
        length += 1
    return found.orderBy("length", "nodes").limit(limit)


def _brandes(n: int, heads: np.ndarray, tails: np.ndarray, costs: np.ndarray, ids: np.ndarray):
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, c in zip(heads.tolist(), tails.tolist(), costs.tolist()):
        out[a].append((b, c))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n)
        for frame in frames:
            for s in frame["pivot"].tolist():
                dist, paths, before, order = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), []
                heap, done = [(0, s)], set()
                while heap:
                    d, v = heapq.heappop(heap)
                    if v in done:
                        continue
                    done.add(v)
                    order.append(v)
                    for w, c in out[v]:
                        if w not in dist or d + c < dist[w]:
                            dist[w] = d + c
                            paths[w], before[w] = paths[v], [v]
                            heapq.heappush(heap, (d + c, w))
                        elif d + c == dist[w] and w not in done:
                            paths[w] += paths[v]
                            before[w].append(v)
                part = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        part[v] += paths[v] / paths[w] * (1 + part[w])
                    if w != s:
                        total[w] += part[w]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids[some], "part": total[some]})

    return run


def betweenness(graph: Graph, pivots: int = PIVOTS, max_vertices: int = SMALL_GRAPH) -> DataFrame:
    """(id, score): share of cheapest paths that pass through a vertex, weights taken as distances, rounded to 6 places.

    For graphs of at most max_vertices vertices, which is checked: their arcs go to every task, and the
    sources are spread over the tasks. With more vertices than ``pivots``, the first ones by md5 of their id
    stand for all and the score is scaled up.
    """
    ids = sorted(r[0] for r in graph.vertices.select("id").limit(max_vertices + 1).collect())
    n = len(ids)
    if n > max_vertices:
        raise ValueError(f"more than {max_vertices} vertices; use critical_by_degree")
    index = {v: i for i, v in enumerate(ids)}
    arcs = graph.arcs.where("src <> dst").select("src", "dst", distance().alias("d")).toPandas()
    spark = graph.vertices.sparkSession
    schema = "id string, part double"
    some = graph.vertices.orderBy(F.md5("id"), "id").limit(pivots)
    chosen = [index[r[0]] for r in some.select("id").collect()]
    k = len(chosen)
    scale = (n / k if k else 1) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    parts = spark.createDataFrame([(i,) for i in chosen], "pivot int").repartition(min(max(1, k // 16), 64))
    run = _brandes(n, arcs["src"].map(index).to_numpy(np.int64), arcs["dst"].map(index).to_numpy(np.int64), arcs["d"].to_numpy(np.int64), np.array(ids, object))
    sums = parts.mapInPandas(run, schema).groupBy("id").agg(F.sum("part").alias("part"))
    return graph.vertices.select("id").join(sums, "id", "left").select("id", F.round(F.coalesce("part", F.lit(0.0)) * scale, 6).alias("score"))


def critical_nodes(graph: Graph, top: int = 20, max_vertices: int = SMALL_GRAPH, pivots: int = PIVOTS) -> DataFrame:
    """The vertices that matter most: by betweenness in small graphs, else by degree; ties by id."""
    if graph.vertices.limit(max_vertices + 1).count() > max_vertices:
        return critical_by_degree(graph, top)
    into = graph.arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    out = graph.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    r = betweenness(graph, pivots, max_vertices).join(graph.vertices.select("id", "name", "type"), "id").join(into, "id", "left").join(out, "id", "left").na.fill(0)
    return r.orderBy(F.desc("score"), "id").limit(top).select("id", "name", "type", "score", "in_degree", "out_degree")


def _through(start: np.ndarray, to: np.ndarray, cost: np.ndarray, first: np.ndarray, size: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For every vertex, the sum over the pivots of its share of cheapest paths from the pivot that pass through it.

    start, to, cost: arcs by vertex, costs whole and positive; first, size: the vertices of each pivot's graph. All pivots advance
    together, from one distance to the next; a place is a vertex as seen from a pivot.
    """
    base = np.cumsum(size) - size
    shift = base - first  # from a vertex to its place
    dist, paths, below = np.full(size.sum(), 1 << 40), np.zeros(size.sum()), np.zeros(size.sum())
    dist[pivots + shift], paths[pivots + shift] = 0, 1.0
    coming, done, at, moves = {}, [], pivots + shift, shift
    d = 0
    while True:
        v = at - moves
        n = start[v + 1] - start[v]
        arcs = np.repeat(start[v] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        before, move = np.repeat(at, n), np.repeat(moves, n)
        after, there = to[arcs] + move, d + cost[arcs]
        np.minimum.at(dist, after, there)
        good = there == dist[after]
        for x in np.unique(there[good]).tolist():
            coming.setdefault(x, []).append([y[good & (there == x)] for y in (before, after, move)])
        if not coming:
            break
        d = min(coming)
        before, after, move = (np.concatenate(x) for x in zip(*coming.pop(d)))
        good = dist[after] == d  # else a cheaper way was found since
        before, after, move = before[good], after[good], move[good]
        np.add.at(paths, after, paths[before])
        done.append((before, after))
        at, one = np.unique(after, return_index=True)
        moves = move[one]
    for before, after in reversed(done):
        np.add.at(below, before, paths[before] / paths[after] * (1 + below[after]))
    below[pivots + shift] = 0
    return np.bincount(np.arange(len(below)) - np.repeat(shift, size), below, len(start) - 1)


def _betweenness_parts(rows: pd.DataFrame) -> pd.DataFrame:
    """(id, part): betweenness in the graphs whose arcs are given, from the pivots of their parts; so many pivots at once as PLACES allows."""
    ids, frames, first, n = [], [], [], 0
    for (_, part), x in rows.groupby(["repo_id", "part"]):
        names, ends = np.unique(x[["src", "dst"]].to_numpy(object).ravel(), return_inverse=True)
        src, dst = ends.reshape(-1, 2).T
        chosen = np.unique(src[x["pivot"].to_numpy(bool)])[part :: int(x["parts"].iat[0])]
        frames.append((src + n, dst + n, x["d"].to_numpy(np.int64)))
        first.append((chosen + n, n, len(names)))
        ids.append(names)
        n += len(names)
    src, dst, d = (np.concatenate(x) for x in zip(*frames))
    order = np.argsort(src, kind="stable")
    start = np.searchsorted(src[order], np.arange(n + 1))
    pivots = np.concatenate([p for p, _, _ in first])
    at, size = (np.concatenate([np.full(len(p), (f, m)[i]) for p, f, m in first]).astype(np.int64) for i in (0, 1))
    total, turn = np.zeros(n), np.cumsum(size) // PLACES
    for i in np.unique(turn):
        total += _through(start, dst[order], d[order], at[turn == i], size[turn == i], pivots[turn == i])
    some = np.flatnonzero(total)
    return pd.DataFrame({"id": np.concatenate(ids)[some], "part": total[some]})


def own_arcs(graph: Graph) -> DataFrame:
    """The arcs whose ends are of one repository, with its repo_id."""
    if "repo_id" in graph.arcs.columns:
        return graph.arcs
    v = graph.vertices
    return graph.arcs.join(v.select(F.col("id").alias("src"), "repo_id"), "src").join(v.select(F.col("id").alias("dst"), F.col("repo_id").alias("r2")), "dst").where("repo_id = r2").drop("r2")


def scored_by_repo(graph: Graph, max_vertices: int = SMALL_GRAPH, pivots: int = PIVOTS, blocks: int | None = None) -> DataFrame:
    """The vertices of all repositories with their degrees, score and method, each repository a graph of its own. Degrees that the vertices have already, by arcs within repositories, are taken over.

    The rule of size is the one of a single graph: up to max_vertices the score is betweenness (from all
    vertices, or from ``pivots`` of them), above it the degree; ``method`` says which. The graphs of small
    repositories go to tasks with their arcs, in as many parts of their pivots as their work asks for (or in ``blocks`` parts); their
    size is bounded by max_vertices. Large ones are aggregated.
    """
    v = graph.vertices
    sizes = v.groupBy("repo_id").agg(F.count("*").alias("n")).withColumn("small", F.col("n") <= max_vertices)
    own = own_arcs(graph).join(F.broadcast(sizes), "repo_id")  # a row per repository
    own = own if "repo_id" in graph.arcs.columns else checkpointed(own)
    degree = v if "in_plain" in v.columns else gr.degrees(Graph(v, own.select("src", "dst", "relation", "confidence", "weight", "seq")))
    # pivots of repositories with more vertices than pivots: at most ``pivots`` of each
    ranked = first_rows(v.join(F.broadcast(sizes.where(f"small AND n > {pivots}")), "repo_id").select("repo_id", "id", F.md5("id").alias("h")), ["repo_id"], ["h", "id"], pivots)
    arcs = own.where("small AND src <> dst").select("repo_id", "src", "dst", distance().alias("d"), "n")
    work = arcs.groupBy("repo_id").agg((F.count("*") * F.least(F.max("n"), F.lit(pivots))).alias("work"))
    parts = F.lit(blocks) if blocks else F.least(F.ceil(F.col("work") / WORK), F.lit(pivots)).cast("int")
    arcs = arcs.join(F.broadcast(work.select("repo_id", parts.alias("parts"))), "repo_id").join(ranked.select(F.col("id").alias("src"), F.lit(True).alias("some")), "src", "left")
    arcs = arcs.select("repo_id", "src", "dst", "d", (F.coalesce("some", F.lit(False)) | (F.col("n") <= pivots)).alias("pivot"), "parts")
    arcs = checkpointed(arcs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    # small rows, long work: so many partitions that none is merged with others by its size
    slots = max(4 * v.sparkSession.sparkContext.defaultParallelism, arcs.count() // SLOT)
    arcs = arcs.withColumn("slot", F.pmod(F.xxhash64("repo_id", "part"), F.lit(slots))).repartition(slots, "slot")
    parts = arcs.groupBy("slot").applyInPandas(_betweenness_parts, "id string, part double").groupBy("id").agg(F.sum("part").alias("part"))
    n = F.col("n").cast("double")
    scale = F.when(n > 2, F.greatest(n / F.lit(float(pivots)), F.lit(1.0)) / ((n - 1) * (n - 2))).otherwise(0.0)
    d = degree.join(F.broadcast(sizes), "repo_id").join(parts, "id", "left")
    score = F.when(F.col("small"), F.round(F.coalesce("part", F.lit(0.0)) * scale, 6)).otherwise((F.col("in_plain") + F.col("out_plain")).cast("double"))
    return d.withColumns({"score": score, "method": F.when(F.col("small"), "betweenness").otherwise("degree")})


def critical_by_repo(graph: Graph, top: int = 20, max_vertices: int = SMALL_GRAPH, pivots: int = PIVOTS, blocks: int | None = None) -> DataFrame:
    """(repo_id, id, name, type, score, method, in_degree, out_degree): the ``top`` vertices of every repository by :func:`scored_by_repo`."""
    best = first_rows(scored_by_repo(graph, max_vertices, pivots, blocks), ["repo_id"], [F.desc("score"), "id"], top)
    return best.select("repo_id", "id", "name", "type", "score", "method", "in_degree", "out_degree")


def _moved(u: np.ndarray, v: np.ndarray, w: np.ndarray, rest: np.ndarray, total: float) -> list[int]:
    """Local moving over one graph: the community of every vertex, named by one of its vertices.

    u, v, w: links between different vertices; rest: what a vertex weighs besides. A vertex joins the neighbouring community
    with the largest gain in modularity; then those of its neighbours that are elsewhere look again, until no vertex wants to move.
    """
    n = len(rest)
    order = np.argsort(np.concatenate([u, v]), kind="stable")
    heads, tails, weights = (np.concatenate(x)[order] for x in ((u, v), (v, u), (w, w)))
    start, k = np.searchsorted(heads, np.arange(n + 1)).tolist(), (rest + np.bincount(heads, weights, n)).tolist()
    tails, weights, tot, at, least = tails.tolist(), weights.tolist(), k.copy(), list(range(n)), LEAST_GAIN * total
    waiting, queued = deque(range(n)), bytearray(b"\1" * n)
    while waiting:
        i = waiting.popleft()
        queued[i] = 0
        here, share, first, last = at[i], k[i] / total, start[i], start[i + 1]
        near = {here: 0.0}
        for j, x in zip(tails[first:last], weights[first:last]):
            d = at[j]
            near[d] = near.get(d, 0.0) + x
        best, gain = here, near[here] - share * (tot[here] - k[i]) + least
        for d, x in near.items():
            if d != here and (g := x - share * tot[d]) > gain:
                best, gain = d, g
        if best != here:
            at[i] = best
            tot[here] -= k[i]
            tot[best] += k[i]
            for j in tails[first:last]:
                if not queued[j] and at[j] != best:
                    queued[j] = 1
                    waiting.append(j)
    return at


def _merged(u: np.ndarray, v: np.ndarray, w: np.ndarray, rest: np.ndarray, total: float, whole: bool) -> np.ndarray:
    """The community of every vertex after local moving; ``whole``: communities are merged and moved on until nothing merges."""
    at = np.arange(len(rest))
    while True:
        names, to = np.unique(_moved(u, v, w, rest, total), return_inverse=True)
        at = to[at]
        if not whole or len(names) == len(rest):
            return at
        u, v = to[u], to[v]
        inside, n = u == v, len(names)
        rest = np.bincount(to, rest, n) + 2 * np.bincount(u[inside], w[inside], n)
        pair, one = np.unique(np.minimum(u, v)[~inside] * n + np.maximum(u, v)[~inside], return_inverse=True)
        u, v, w = pair // n, pair % n, np.bincount(one, w[~inside], len(pair))


def _blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """(u, c): the communities of a block's vertices, each named by its least vertex. rows: links, and with v = u what a vertex weighs besides."""
    out = []
    for _, x in rows.groupby("g"):
        ids, to = np.unique(x[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        u, v = to.reshape(-1, 2).T
        w, loop = x["w"].to_numpy(float), u == v
        links = np.lexsort((v[~loop], u[~loop]))  # the order of the rows doesn't matter
        rest = np.bincount(u[loop], w[loop], len(ids))
        at = _merged(u[~loop][links], v[~loop][links], w[~loop][links], rest, float(x["m"].iat[0]), bool(x["whole"].iat[0]))
        first = np.full(len(ids), ids[-1])
        np.minimum.at(first, at, ids)
        out.append(pd.DataFrame({"u": ids, "c": first[at]}))
    return pd.concat(out)


def _moved_together(links: DataFrame, level: int, epsilon: float) -> DataFrame:
    """(u, c): one level of local moving, done for all vertices at once.

    links: (u, v, w) both ways, a loop once and twice as heavy; the weights of a graph add up to 1. In a round every vertex looks at its
    neighbours' communities and half of the vertices (by a hash that changes each round) move to the one with the largest gain in
    modularity. It ends when no vertex wants to move, or when PATIENCE rounds have not raised modularity by ``epsilon``; the best state
    counts. A round is a join and an aggregation, checkpointed; nothing is collected but sums.
    """
    hubs = checkpointed(hot_keys(links, "v"))
    state = checkpointed(links.groupBy("u").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("loop")).select("u", "k", "loop", F.col("u").alias("c")))
    ways = checkpointed(spread_join(links.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w"), state.select(F.col("u").alias("v"), "k"), "v", hubs).select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "k"))
    best_q, best_state, mark, since, r = -2.0, state, -2.0, 0, 0
    while True:
        sizes = state.groupBy(F.col("c").alias("d")).agg(F.sum("k").alias("tot"))
        to = spread_join(ways, state.select(F.col("u").alias("v"), F.col("c").alias("d")), "v", hubs).select("u", "d", "w", "k", F.lit(False).alias("here"), F.lit(0.0).alias("loop"))
        stay = state.select("u", F.col("c").alias("d"), F.lit(0.0).alias("w"), "k", F.lit(True).alias("here"), "loop")
        options = to.unionByName(stay).groupBy("u", "d").agg(F.sum("w").alias("w"), F.max("k").alias("k"), F.max("here").alias("here"), F.max("loop").alias("loop")).join(sizes, "d")
        here = F.col("here")
        tot = F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * tot, 12)
        # the part of the state's modularity: what the vertex has inside, less what chance would give it there
        part = F.when(here, F.col("w") + F.col("loop") - F.col("k") * F.col("tot"))
        own = F.max(F.when(here, F.struct("d", "k", "loop")))
        best = options.groupBy("u").agg(F.max(F.struct(gain.alias("gain"), here.alias("here"), F.col("d").alias("d"))).alias("best"), F.max(part).alias("part"), own.alias("own"))
        turn = F.pmod(F.xxhash64("u", F.lit(level), F.lit(r)), F.lit(2)) == 0
        nxt = checkpointed(best.select("u", "own.k", "own.loop", F.when(turn, F.col("best.d")).otherwise(F.col("own.d")).alias("c"), (F.col("best.d") != F.col("own.d")).alias("wants"), "part"))
        q, wants = nxt.agg(F.sum("part"), F.count_if("wants")).first()
        mark, since = (q, 0) if q > mark + epsilon else (mark, since + 1)
        if q > best_q:
            best_q, best_state = q, state
        if not wants or since >= PATIENCE:
            return best_state.select("u", "c")
        state, r = nxt.select("u", "k", "loop", "c"), r + 1


def _numbered(vertices: DataFrame, by: str | None) -> tuple[DataFrame, int]:
    """(id, node, g, near, here): every vertex with a number, its graph, and where it lies; numbers are hashes of the ids with the first seed by which no two are the same. Also the seed."""
    seed = 0
    while True:
        v = checkpointed(vertices.select("id", F.xxhash64(F.lit(seed), "id").alias("node"), (F.when(F.col(by).isNotNull(), F.xxhash64(by)) if by else F.lit(0).cast("bigint")).alias("g"), F.xxhash64("repo_id").alias("near"), F.xxhash64("repo_id", "file_path").alias("here")))
        if v.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return v, seed
        seed += 1


def _in_blocks(rows: DataFrame, level: int, n: int, block: int) -> DataFrame:
    """(u, c): one level of local moving within blocks; graphs of at most ``block`` links are done whole. n: the number of rows."""
    large = F.col("n") > block
    inside = rows.where(large & (F.col("near_u") == F.col("near_v"))).groupBy(F.col("near_u").alias("near")).agg(F.count("*").alias("k"))  # a row per repository
    rows = rows.join(F.broadcast(inside.withColumnsRenamed({"near": "near_u", "k": "k_u"})), "near_u", "left").join(F.broadcast(inside.withColumnsRenamed({"near": "near_v", "k": "k_v"})), "near_v", "left")

    def zone(end):
        near, here, k = (F.col(f"{c}_{end}") for c in ("near", "here", "k"))
        spread = F.pmod(F.xxhash64(near, F.lit(level)), F.ceil(2 * F.col("n") / block))
        parts = F.xxhash64(near, F.pmod(F.xxhash64(here, F.lit(level)), F.ceil(2 * k / block)))
        return F.when(large, F.when(k > block, parts).otherwise(spread)).otherwise(0)

    u, v, w = F.col("u"), F.col("v"), F.col("w")
    row = lambda z, x, y, w: F.struct(z.alias("zone"), x.alias("u"), y.alias("v"), w.alias("w"))
    mine = F.when(F.col("zu") == F.col("zv"), F.array(row(F.col("zu"), u, v, F.when(u == v, 2 * w).otherwise(w)))).otherwise(F.array(row(F.col("zu"), u, u, w), row(F.col("zv"), v, v, w)))
    rows = rows.withColumns({"zu": zone("u"), "zv": zone("v")}).select("g", "m", (~large).alias("whole"), F.explode(mine).alias("x"))
    parts = -(-2 * n // block)
    small = F.pmod(F.xxhash64("g"), F.lit(parts))
    rows = rows.select(F.when(F.col("whole"), small).otherwise(F.xxhash64("g", "x.zone")).alias("block"), "whole", "g", "m", "x.u", "x.v", "x.w")
    tasks = max(parts, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "block").groupBy("block").applyInPandas(_blocks, "u bigint, c bigint")


def communities(graph: Graph, min_size: int = 2, epsilon: float = EPSILON, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """(id, community): groups with more weight inside than chance would give; a community is named by its least id.

    Louvain's local moving, level by level until nothing merges. A graph of at most ``block`` links is done by one task.
    Of a larger one, every task moves the vertices of a block (repositories, or some files of a large one), by gains that
    count all links and the weight of the whole graph; communities are then merged into vertices of the next level, until
    the rest fits into a block. Where blocks hardly merge anything, a level is done for all vertices at once
    (:func:`_moved_together`); if that merges nothing either, it was the last. Reciprocal arcs count once, with the weight
    of the later one; weights count in whole millionths, so no sum depends on the order of its rows. Communities smaller
    than min_size are left out. With ``by``, a column of the vertices, every group of vertices is a graph of its own (arcs
    between groups are left out), all of them at once. Vertices with many arcs are joined by broadcast.
    """
    vertices, seed = _numbered(graph.vertices, by)
    a, b = F.xxhash64(F.lit(seed), "src"), F.xxhash64(F.lit(seed), "dst")
    und = graph.arcs.where("src <> dst").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.round(F.col("weight") * 1_000_000).cast("bigint").alias("w"), "seq")
    links = checkpointed(und.groupBy("u", "v").agg(F.max_by("w", "seq").alias("w")))
    lies = lambda end: vertices.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("g", "near", "here")))
    member, level, together = vertices.select("node", F.col("node").alias("c")), 0, False
    while True:
        hubs = checkpointed(hot_keys(links.select(F.explode(F.array("u", "v")).alias("u")), "u"))
        by_ends = lambda rows, u, v: spread_join(spread_join(rows, u, "u", hubs), v, "v", hubs.withColumnRenamed("u", "v"))  # noqa: E731, B023
        rows = checkpointed(by_ends(links, lies("u"), lies("v")).where("g_u = g_v").withColumnRenamed("g_u", "g").drop("g_v"))
        sizes = rows.groupBy("g").agg(F.count("*").alias("n"), (2 * F.sum("w")).alias("m"))  # a row per graph
        n, most = sizes.agg(F.sum("n"), F.max("n")).first()
        if not n:
            break
        rows, together = rows.join(F.broadcast(sizes), "g"), together and most > block
        if together:
            share, ends = F.col("w") / F.col("m"), [("u", "v"), ("v", "u")]
            both = [rows.select(F.col(x).alias("u"), F.col(y).alias("v"), share.alias("w")) for x, y in ends]
            found = checkpointed(_moved_together(both[0].unionByName(both[1]).groupBy("u", "v").agg(F.sum("w").alias("w")), level, epsilon))
        else:
            found = checkpointed(_in_blocks(rows, level, n, block))
        of = lambda end: found.select(F.col("u").alias(end), F.col("c").alias(f"c_{end}"))  # noqa: E731, B023
        member = checkpointed(spread_join(member, of("c"), "c", hot_keys(member, "c")).select("node", F.coalesce("c_c", "c").alias("c")))
        if most <= block and not together:
            break
        before, after = found.agg(F.count("*"), F.count_distinct("c")).first()
        if together and after == before:
            break
        c, rest = (F.col("c_u"), F.col("c_v")), rows if together else rows.where(F.col("n") > block)
        together = not together and after > STUCK * before
        links = by_ends(rest, of("u"), of("v")).groupBy(F.least(*c).alias("u"), F.greatest(*c).alias("v")).agg(F.sum("w").alias("w"))
        links, level = checkpointed(links), level + 1
    all_ = vertices.select("id", "node").join(member, "node")
    named = all_.groupBy("c").agg(F.min("id").alias("community"), F.count("*").alias("size")).where(F.col("size") >= min_size)
    return all_.join(named, "c").select("id", "community")


def modularity(graph: Graph, groups: DataFrame) -> float:
    """Modularity of a partition (id, community); vertices without one are alone."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    und = graph.arcs.where("src <> dst").groupBy(a.alias("a"), b.alias("b")).agg(F.max_by("weight", "seq").alias("w"))
    g = graph.vertices.join(groups, "id", "left").select("id", F.coalesce("community", "id").alias("c"))
    e = und.join(g.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(g.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    m = e.agg(F.sum("w")).first()[0]
    if not m:
        return 0.0
    inside = e.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    ends = e.select(F.col("ca").alias("c"), "w").unionByName(e.select(F.col("cb").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("k"))
    return inside / m - ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (4 * m * m)


def described(members: DataFrame, show_files: int = 20) -> DataFrame:
    """(community, label, files) of the communities of ``members`` (community, id, name, file_path): the three shortest names and the first files. Only the rows that are shown are ever collected into a list."""
    names = members.where("name IS NOT NULL").select("community", F.lit(True).alias("named"), F.length("name").alias("n"), F.col("name").alias("text"), "id")
    paths = members.where("file_path IS NOT NULL").select("community", F.lit(False).alias("named"), F.lit(0).alias("n"), F.col("file_path").alias("text"), F.lit("").alias("id")).distinct()
    rows = first_rows(names.unionByName(paths), ["community", "named"], ["n", "text", "id"], max(3, show_files))
    listed = lambda named, k: F.transform(F.array_sort(F.collect_list(F.when((F.col("named") == named) & (F.col("place") <= k), F.struct("place", "text")))), lambda x: x["text"])
    return rows.groupBy("community").agg(F.array_join(listed(True, 3), " / ").alias("label"), listed(False, show_files).alias("files"))


def community_report(graph: Graph, groups: DataFrame, show_nodes: int = 50, show_files: int = 20) -> DataFrame:
    """Communities: size, label of the three shortest names, first files and nodes. Only the rows that are shown are ever collected into a list."""
    m = groups.join(graph.vertices, "id")
    sizes = m.groupBy("community").agg(F.count("*").alias("size"))
    nodes = first_rows(m.select("community", "id"), ["community"], ["id"], show_nodes)
    nodes = nodes.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("nodes"))
    r = sizes.join(described(m, show_files), "community", "left").join(nodes, "community", "left")
    return r.select("community", "size", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), "nodes")
