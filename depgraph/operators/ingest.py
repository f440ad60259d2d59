"""Ingest: files to a stored, versioned graph, in full or only what changed."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph import schema
from depgraph.operators import extract as ex
from depgraph.operators import graph as gr
from depgraph.operators import overview as ov
from depgraph.operators import search as se
from depgraph.operators import store as st
from depgraph.sources.files import file_states

#: Versions whose rows stay when older ones are removed.
KEPT_VERSIONS = 2


class Store:
    """A folder of tables partitioned by version and repository, and manifests that say which version of each repository counts.

    A commit writes the repositories it touched, then a manifest, then an empty file whose name is the version:
    the greatest such name is the current version, so readers see all of a commit or nothing of it, and a failed
    one leaves the store as it was. Repositories that a commit doesn't touch are neither read nor written.
    repos and repo_metrics are small (a row per repository and metric) and written whole. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Committed versions, oldest first."""
        path, fs = self._path("current")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def version(self) -> str | None:
        return (self.versions() or [None])[-1]

    def manifest(self, version: str | None = None) -> DataFrame | None:
        """(repo_id, v): the version in which each repository was written last."""
        v = version or self.version()
        return self.spark.read.schema(schema.MANIFEST).parquet(f"{self.folder}/manifests/{v}") if v else None

    def table(self, name: str, repos: DataFrame | None = None) -> DataFrame | None:
        """A table as it is now; with ``repos`` (repo_id), only their rows. Partitions of other versions aren't read."""
        v = self.version()
        if not v:
            return None
        if name not in schema.BY_REPO:
            return self.spark.read.schema(schema.REPOS if name == "repos" else schema.REPO_METRICS).parquet(f"{self.folder}/{name}/{v}")
        m = self.manifest()
        m = m if repos is None else m.join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
        rows = self.spark.read.schema(f"{schema.BY_REPO[name]}, v string, repo_id string").parquet(f"{self.folder}/{name}")
        return rows.join(F.broadcast(m), ["repo_id", "v"], "left_semi").drop("v")  # a row per repository

    def commit(self, touched: DataFrame, tables: dict[str, DataFrame], repos: DataFrame, metrics: DataFrame | None = None) -> str:
        """touched: (repo_id) of the repositories whose rows are in ``tables``."""
        v = f"v{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
        touched = touched.select("repo_id").distinct()
        for name, df in tables.items():
            columns = [c.strip().split(" ")[0] for c in _split(schema.BY_REPO[name])]
            df.select(*columns, "repo_id").repartition("repo_id").write.partitionBy("repo_id").parquet(f"{self.folder}/{name}/v={v}")
        now = touched.select("repo_id", F.lit(v).alias("v"))
        old = self.manifest()
        (now if old is None else old.join(touched, "repo_id", "left_anti").unionByName(now)).write.parquet(f"{self.folder}/manifests/{v}")
        repos.coalesce(1).write.parquet(f"{self.folder}/repos/{v}")
        kept = self.table("repo_metrics")
        new = metrics if metrics is not None else self.spark.createDataFrame([], schema.REPO_METRICS)
        st.upsert_metrics(kept, new).coalesce(1).write.parquet(f"{self.folder}/repo_metrics/{v}")
        path, fs = self._path(f"current/{v}")
        fs.create(path, True).close()
        return v

    def clean(self, keep: int = KEPT_VERSIONS) -> list[str]:
        """Remove what no manifest of the last ``keep`` versions names; returns the removed versions."""
        have = self.versions()
        live = {r["v"] for v in have[-keep:] for r in self.manifest(v).select("v").distinct().collect()} | set(have[-keep:])
        gone = [v for v in have if v not in live]
        for v in have[:-keep]:
            for name in ("current", "manifests", "repos", "repo_metrics"):
                path, fs = self._path(f"{name}/{v}")
                fs.delete(path, True)
        for v in gone:
            for name in schema.BY_REPO:
                path, fs = self._path(f"{name}/v={v}")
                fs.delete(path, True)
        return gone


def _split(fields: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def ingest(store: Store, files: DataFrame, force: bool = False, complete: bool = True, repos: DataFrame | None = None, metrics: bool = False) -> dict[str, int]:
    """Bring the store up to date with files (repo_id, file_path, language, content, file_hash; one row per path).

    Hashes are compared first, and only new and changed files are parsed. A file that no longer parses keeps
    its old rows and is counted as an error, with its old hash, so it is tried again. With ``complete``,
    files of the repositories in ``files`` that are missing there are removed. The edges of the repositories
    in ``files`` are resolved anew from their stored raw edges, so an incremental ingest gives the same store as a
    full one; dangling edges are never kept; search postings are made anew for them, too. ``force`` parses
    everything. Null contents count as errors; rows without repository are left out; an empty table changes
    nothing. ``repos`` (id, path, name) describes the repositories; without it they are named by their ids.
    With ``metrics``, the overviews of these repositories are computed and kept. If it fails, the repositories
    get the status error and everything else stays as it was.
    """
    spark = store.spark
    files = files.where("repo_id IS NOT NULL").select("repo_id", "file_path", F.lower("language").alias("language"), "content", "file_hash")
    folder = f"staging-{uuid.uuid4().hex[:8]}"

    def staged(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{store.folder}/{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{store.folder}/{folder}/{name}")

    try:
        given = staged("repos", files.select("repo_id").distinct())
        if given.isEmpty():
            return {"version": store.version(), "indexed": 0, "errors": 0, "skipped": 0, "removed": 0, "nodes": 0, "edges": 0}
        known = store.table("repos")
        described = given.select(F.col("repo_id").alias("id"), F.col("repo_id").alias("name"), F.lit("").alias("path"))
        if repos is not None:
            described = described.select("id").join(repos.select("id", "name", "path"), "id", "left").select("id", F.coalesce("name", "id").alias("name"), F.coalesce("path", F.lit("")).alias("path"))
        listed = st.upsert_repos(spark.createDataFrame([], schema.REPOS) if known is None else known, described.withColumn("status", F.lit("indexing")))
        try:
            result = _ingest(store, files, given, listed, staged, force, complete, metrics)
        except Exception:
            if known is not None:
                store.commit(given.where("false"), {}, st.set_status(listed, given.withColumnRenamed("repo_id", "id"), "error"))
            raise
    finally:
        path, fs = store._path(folder)
        fs.delete(path, True)
    store.clean()
    return result


def _ingest(store, files, given, listed, staged, force, complete, metrics) -> dict[str, int]:
    names = ("files", "nodes", "raw_edges")
    old = {t: store.table(t, given) for t in names}
    if old["files"] is None:
        states = files.select("repo_id", "file_path", F.lit("new").alias("state"))
    else:
        seen = old["files"] if complete else old["files"].join(files.select("repo_id", "file_path"), ["repo_id", "file_path"], "left_semi")
        states = file_states(files, seen)
    states = staged("states", states)
    todo = states.where("state IN ('new', 'changed')" if not force else "state <> 'stale'").select("repo_id", "file_path")
    parsed = staged("parsed", ex.extract_files(files.join(todo, ["repo_id", "file_path"], "left_semi")))
    good = parsed.where("error IS NULL")
    done = good.select("repo_id", "file_path")
    replaced = done.unionByName(states.where("state = 'stale'").select("repo_id", "file_path"))
    new = {"nodes": ex.extracted_nodes(good), "raw_edges": ex.extracted_edges(good), "files": files.join(done, ["repo_id", "file_path"], "left_semi").select("repo_id", "file_path", "language", "file_hash")}
    if old["files"] is not None:
        new = {t: st.delete_files(old[t], replaced).unionByName(new[t]) for t in names}
    new = {t: staged(t, df) for t, df in new.items()}
    nodes = new["nodes"]
    edges = staged("edges", st.referenced_edges(resolve(new["raw_edges"], nodes), nodes))
    index, of = se.build_index(nodes), nodes.select("id", "repo_id")
    tables = new | {"edges": edges, "postings": index.postings.join(of, "id"), "lengths": index.lengths.join(of, "id")}
    kept = None
    if metrics:
        weighed = edges.withColumn("weight", st.weight()).withColumn("seq", F.xxhash64("seq"))
        kept = ov.overviews(gr.load_graph(nodes, weighed), nodes, weighed).withColumn("computed_at", F.current_timestamp())
    v = store.commit(given, tables, st.finish_repos(listed, given.withColumnRenamed("repo_id", "id"), nodes, edges), kept)
    counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    result = {"version": v, "indexed": done.count(), "errors": parsed.where("error IS NOT NULL").count(), "skipped": counts.get("skipped", 0) if not force else 0, "removed": counts.get("stale", 0)}
    return result | {"nodes": nodes.count(), "edges": edges.count()}


def resolve(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of raw edges whose order is a struct (file, place) instead of a number."""
    index = st.name_index(nodes)
    found = raw.withColumn("key", F.lower("tgt_name")).join(index.withColumnRenamed("id", "named"), ["repo_id", "key"], "left")
    rows = found.withColumn("target_id", F.coalesce("tgt", "named")).where("target_id IS NOT NULL AND src IS NOT NULL AND src <> target_id")
    last = F.max_by(F.struct("repo_id", "confidence", F.col("line").alias("source_line"), "seq"), "seq")
    return rows.groupBy(F.concat_ws("::", "src", "relation", "target_id").alias("id"), F.col("src").alias("source_id"), "target_id", "relation").agg(last.alias("r")).select("id", "source_id", "target_id", "relation", "r.repo_id", "r.confidence", "r.source_line", "r.seq")
