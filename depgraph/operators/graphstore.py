"""The code graph stored once and queried often: deduplicated nodes and edges, collapsed arcs both ways, search postings and repository metrics."""

from __future__ import annotations

import hashlib
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.operators import graph as gr
from depgraph.operators import search as se
from depgraph.operators import store as st
from depgraph.sources.shared import drop, shared_folder


@dataclass
class CodeGraph:
    """nodes and edges: one row per id; graph: with arcs sorted by source; reverse: the same arcs sorted by target; index: for search; ends: edges per node, parallel ones included."""

    nodes: DataFrame
    edges: DataFrame
    graph: gr.Graph
    reverse: gr.Graph
    index: se.Index
    ends: DataFrame


_WRITING = threading.Lock()
#: Changes when what is stored for the same tables does.
FORMAT = 1
#: Tables of a stored graph and the column by which each is ranged and sorted, so that files and row groups are skipped by it.
LAYOUT = {"nodes": "id", "edges": "source_id", "arcs_out": "src", "arcs_in": "dst", "postings": "term", "lengths": "id", "ends": "id"}


def write(folder: str, nodes: DataFrame, edges: DataFrame) -> None:
    """Write the tables of a stored graph below a folder. nodes and edges may hold repeated ids; the latest rows count."""
    spark = nodes.sparkSession

    def put(name, df):
        df.repartitionByRange(F.col(LAYOUT[name])).sortWithinPartitions(LAYOUT[name]).write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    n = put("nodes", st.latest_nodes(nodes))
    e = put("edges", st.latest_edges(edges))
    arcs = put("arcs_out", gr.load_graph(n, e).arcs)
    put("arcs_in", arcs)
    index = se.build_index(n)
    put("postings", index.postings)
    put("lengths", index.lengths)
    put("ends", st.node_details(n, e).select("id", "in_degree", "out_degree"))


def read(spark: SparkSession, folder: str) -> CodeGraph:
    t = {name: spark.read.parquet(f"{folder}/{name}") for name in LAYOUT}
    v = t["nodes"].select("id", "repo_id", "type", "name", "file_path", "language")
    return CodeGraph(t["nodes"], t["edges"], gr.Graph(v, t["arcs_out"]), gr.Graph(v, t["arcs_in"]), se.Index(t["postings"], t["lengths"]), t["ends"])


def update_index(index: se.Index, changed: DataFrame, gone: DataFrame) -> se.Index:
    """The index after some rows changed or came (``changed``, with the indexed columns) and some went (``gone``, ids): only their postings are made anew."""
    old = changed.select("id").unionByName(gone.select("id")).distinct()
    new = se.build_index(changed)
    keep = lambda rows: rows.join(old, "id", "left_anti")
    return se.Index(keep(index.postings).unionByName(new.postings), keep(index.lengths).unionByName(new.lengths))


def _state(spark: SparkSession, *paths: str) -> str:
    """What the given tables look like now: names, sizes and times of their files."""
    out = []
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = fs.listStatus(path)
        out += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files]
    return hashlib.md5("\n".join([f"{FORMAT} {LAYOUT}", *sorted(out)]).encode()).hexdigest()


def stored(spark: SparkSession, folder: str) -> CodeGraph:
    """The stored graph of the tables nodes and edges in a folder, in the shared folder; written if the tables changed since, or never were."""
    at = f"{shared_folder(spark)}/code-graph-{_state(spark, f'{folder}/nodes.parquet', f'{folder}/edges.parquet')}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_DONE")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with _WRITING:
        if not fs.exists(done):
            drop(spark, at)
            write(at, spark.read.parquet(f"{folder}/nodes.parquet"), spark.read.parquet(f"{folder}/edges.parquet"))
            fs.create(done).close()
    return read(spark, at)
