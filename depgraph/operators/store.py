"""The store: repositories, nodes and edges as keyed tables, and the lookups over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depgraph.functions.exprs import weight


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed upsert: of the rows of a key the one with the largest ``order`` stays (nulls are smallest); null keys are dropped."""
    rest = [c for c in rows.columns if c not in (key, order)]
    kept = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(order, *rest), F.coalesce(F.col(order), F.lit("1000-01-01").cast(dict(rows.dtypes)[order]) if dict(rows.dtypes)[order].startswith("timestamp") else F.lit(-(1 << 62)))).alias("r"))
    return kept.select(*(F.col(c) if c == key else F.col(f"r.{c}") for c in rows.columns))


def latest_nodes(nodes: DataFrame) -> DataFrame:
    return latest(nodes, "id", "updated_at")


def latest_edges(edges: DataFrame) -> DataFrame:
    """One row per edge id, the last one ingested; the weight follows from the confidence, whatever was stored."""
    return latest(edges, "id", "seq").withColumn("weight", weight())


def referenced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes. The ends are distinct ids, so a semi join never multiplies a hot one."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def repo_stats(repos: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: real counts of nodes and edges, and counts by language, type and relation as maps.

    nodes and edges hold one row per id. Repositories without nodes have zeros and empty maps.
    """

    def mapped(rows, column, name):
        counts = rows.where(F.col(column).isNotNull()).groupBy("repo_id", column).agg(F.count("*").alias("n"))
        return counts.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column), F.col("n"))))).alias(name))

    n = nodes.groupBy("repo_id").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy("repo_id").agg(F.count("*").alias("n_edges"))
    out = repos.select(F.col("id").alias("repo_id"), "name", "status").join(n, "repo_id", "left").join(e, "repo_id", "left").na.fill(0, ["n_nodes", "n_edges"])
    for rows, column, name in ((nodes, "language", "languages"), (nodes, "type", "node_types"), (edges, "relation", "relations")):
        out = out.join(mapped(rows, column, name), "repo_id", "left")
    empty = F.create_map().cast("map<string,bigint>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("languages", "node_types", "relations")})


def list_files(nodes: DataFrame, language: str | None = None) -> DataFrame:
    rows = nodes if language is None else nodes.where(F.lower("language") == language)
    return rows.groupBy("repo_id", "file_path").agg(F.min("language").alias("language"), F.count("*").alias("n_nodes"))


def files_by_type(nodes: DataFrame) -> DataFrame:
    """The nodes of every file, grouped by type and in order of their lines (unknown lines first): names joined by blanks."""
    item = F.struct(F.coalesce("line_start", F.lit(-1)).alias("line"), "id", "name")
    return nodes.groupBy("repo_id", "file_path", "type").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["name"]), " ").alias("names"))


def node_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with the number of edges that leave and enter it, parallel ones included."""
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.where("target_id IS NOT NULL").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("id", "type", "name", "file_path").join(into, "id", "left").join(out, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def edge_lists(edges: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """(id, direction, other, relation, seq) of all edges of some nodes. A disjunction of ends is a union of two joins."""
    some = ids.select("id") if isinstance(ids, DataFrame) else edges.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    one = lambda a, b, d: edges.where(f"{a} IS NOT NULL").select(F.col(a).alias("id"), F.lit(d).alias("direction"), F.col(b).alias("other"), "relation", "seq").join(some, "id", "left_semi")
    return one("source_id", "target_id", "out").unionByName(one("target_id", "source_id", "in"))


def top_by(rows: DataFrame, column: str, k: int = 1) -> DataFrame:
    """The k most frequent values, ties by value."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def file_hashes(nodes: DataFrame) -> DataFrame:
    """Hash of every file; of several the one of the latest node."""
    return nodes.where("type = 'file'").groupBy("repo_id", "file_path").agg(F.max_by("file_hash", F.struct("updated_at", "id")).alias("file_hash"))


def refresh_repos(repos: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repos with the counts that the tables really have."""
    n = nodes.groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("node_count"))
    e = edges.groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("edge_count"))
    return repos.drop("node_count", "edge_count").join(n, "id", "left").join(e, "id", "left").na.fill(0, ["node_count", "edge_count"])


def upsert_repos(repos: DataFrame, incoming: DataFrame) -> DataFrame:
    """repos with the incoming ones (id, path, name, status and perhaps languages): new ones are added with counts of 0, of known ones the given columns are replaced and the rest stays.

    Of repeated incoming ids the row with the largest name counts; null ids are left out.
    """
    given = [c for c in ("path", "name", "languages", "status") if c in incoming.columns]
    new = incoming.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*given), "name").alias("new"))
    both = repos.withColumn("old", F.lit(True)).join(new, "id", "full_outer")
    pick = {c: F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col(c)) for c in given}
    return both.withColumns(pick | {c: F.coalesce(c, F.lit(0)) for c in ("node_count", "edge_count") if c in repos.columns}).select(*repos.columns)


def set_status(repos: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """repos with another status for those whose id is among ``ids``."""
    mark = ids.select("id").distinct().withColumn("mine", F.lit(True))
    return repos.join(mark, "id", "left").withColumn("status", F.when(F.col("mine"), status).otherwise(F.col("status"))).select(*repos.columns)


def finish_repos(repos: DataFrame, ids: DataFrame, nodes: DataFrame, edges: DataFrame, status: str = "ready") -> DataFrame:
    """repos after those of ``ids`` were indexed: status, time, and the counts that the tables really have; the others stay as they are."""
    mine = ids.select("id").distinct().withColumn("mine", F.lit(True))
    n = nodes.groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("new_nodes"))
    e = edges.groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("new_edges"))
    r = repos.join(mine, "id", "left").join(n, "id", "left").join(e, "id", "left")
    new = {"status": F.lit(status), "last_indexed": F.current_timestamp(), "node_count": F.coalesce("new_nodes", F.lit(0)), "edge_count": F.coalesce("new_edges", F.lit(0))}
    old = {"node_count": F.coalesce("node_count", F.lit(0)), "edge_count": F.coalesce("edge_count", F.lit(0))}
    return r.withColumns({c: F.when(F.col("mine"), v).otherwise(old.get(c, F.col(c))) for c, v in new.items()}).select(*repos.columns)


def delete_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (of nodes or raw edges) without those of some files (repo_id, file_path)."""
    return rows.join(files.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_anti")


def upsert_metrics(metrics: DataFrame | None, new: DataFrame) -> DataFrame:
    """repo_metrics (repo_id, metric, value_json, computed_at) with new values: one row per repository and metric, the latest."""
    columns = ["repo_id", "metric", "value_json", "computed_at"]
    rows = new.select(*columns) if metrics is None else metrics.select(*columns).unionByName(new.select(*columns))
    last = rows.groupBy("repo_id", "metric").agg(F.max(F.struct("computed_at", "value_json")).alias("r"))
    return last.select("repo_id", "metric", "r.value_json", "r.computed_at")


def get_repo(repos: DataFrame, id_: str) -> DataFrame:
    return repos.where(F.col("id") == id_)


def recent_repos(repos: DataFrame) -> DataFrame:
    """Repositories with their place in the order of indexing, latest first, never indexed ones last."""
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("last_indexed"), "id"))  # a row per repository
    return repos.select("id", "name", "status", place.alias("place"))


def name_index(nodes: DataFrame, by: str = "repo_id") -> DataFrame:
    """(repo, key, id): lower-case names, full and last part, with the node each stands for.

    Of nodes with the same full name the last one wins, else of those with the same last part the first.
    """
    full = nodes.select(by, F.lower("name").alias("key"), "id", "ord", F.lit(True).alias("whole"))
    short = nodes.select(by, F.lower(F.element_at(F.split("name", "::"), -1)).alias("key"), "id", "ord", F.lit(False).alias("whole"))
    best = F.coalesce(F.max_by(F.when(F.col("whole"), F.col("id")), F.when(F.col("whole"), F.struct("ord", "id"))), F.min_by(F.when(~F.col("whole"), F.col("id")), F.when(~F.col("whole"), F.struct("ord", "id"))))
    return full.unionByName(short).where("key IS NOT NULL AND key <> ''").groupBy(by, "key").agg(best.alias("id"))


def resolve_edges(raw: DataFrame, index: DataFrame) -> DataFrame:
    """Raw edges with their target: the id they carry, else the node their target name stands for. Unresolved ones and loops are dropped; of equal ids the last stays."""
    found = raw.withColumn("key", F.lower("tgt_name")).join(index.withColumnRenamed("id", "named"), ["repo_id", "key"], "left")
    target = F.coalesce("tgt", "named")
    rows = found.withColumn("target_id", target).where("target_id IS NOT NULL AND src IS NOT NULL AND src <> target_id")
    rows = rows.select(F.concat_ws("::", "src", "relation", "target_id").alias("id"), "repo_id", F.col("src").alias("source_id"), "target_id", "relation", "confidence", F.col("line").alias("source_line"), "seq")
    return latest(rows, "id", "seq").withColumn("weight", weight())
