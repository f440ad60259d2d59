"""Queries of the store, the graph, search and ingest over the whole tables, with the SQL that must agree."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depgraph.api import Api
from depgraph.functions.exprs import ACCENTED, PLAIN, node_id, search_tokens, short_name
from depgraph.operators import algorithms as al
from depgraph.operators import extract as ex
from depgraph.operators import graph as gr
from depgraph.operators import graphstore as gs
from depgraph.operators import ingest as ig
from depgraph.operators import overview as ov
from depgraph.operators import search as se
from depgraph.operators import store as st
from depgraph.plans import golden, lenses
from depgraph.sources import files as fi
from depgraph.sources.shared import kept
from depgraph.sources.tables import table
from depgraph.streaming import ingest as si


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return st.latest_nodes(table(spark, d, "nodes"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return st.latest_edges(table(spark, d, "edges"))


def _graph(spark: SparkSession, d: str, **k) -> gr.Graph:
    return gr.load_graph(_nodes(spark, d), _edges(spark, d), **k)


def _code(spark: SparkSession, d: str) -> gs.CodeGraph:
    """The code graph as it is stored; written by the first query that needs it."""
    return gs.stored(spark, d)


def _busiest_target(spark: SparkSession, d: str, k: int = 1) -> DataFrame:
    """The nodes that most edges point at."""
    return _code(spark, d).ends.where("in_degree > 0").orderBy(F.desc("in_degree"), "id").limit(k).select("id")


def _busiest_source(spark: SparkSession, d: str, k: int = 1) -> DataFrame:
    return _code(spark, d).ends.where("out_degree > 0").orderBy(F.desc("out_degree"), "id").limit(k).select("id")


N = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"
E = "e AS (SELECT * EXCLUDE (weight), CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.7 WHEN 'AMBIGUOUS' THEN 0.4 ELSE 0.5 END AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM edges WHERE id IS NOT NULL) WHERE rn = 1)"
ARCS = """arcs AS (SELECT source_id AS src, target_id AS dst, relation, confidence, weight, seq FROM
  (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY seq DESC) AS k FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL {filter})
  WHERE k = 1 AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n))"""
NE = f"{N}, {E}"
NEA = f"{NE}, {ARCS.format(filter='')}"
TOP_TARGET = "start AS (SELECT target_id AS id FROM e WHERE target_id IN (SELECT id FROM n) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k})"
TOP_SOURCE = "start AS (SELECT source_id AS id FROM e WHERE source_id IN (SELECT id FROM n) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k})"
DEGREES = """din AS (SELECT dst AS id, count(*) AS a, count(*) FILTER (relation <> 'contains') AS p FROM arcs GROUP BY 1),
dout AS (SELECT src AS id, count(*) AS a, count(*) FILTER (relation <> 'contains') AS p FROM arcs GROUP BY 1),
deg AS (SELECT n.*, coalesce(din.a, 0) AS in_degree, coalesce(din.p, 0) AS in_plain, coalesce(dout.a, 0) AS out_degree, coalesce(dout.p, 0) AS out_plain FROM n LEFT JOIN din USING (id) LEFT JOIN dout USING (id))"""
Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- store and lookups -------------------------------------------------------------------------------------------------
@query(f"WITH {N} SELECT id, repo_id, type, name, file_path, language, line_start, file_hash FROM n")
def upsert_nodes(spark, d):
    return _nodes(spark, d).select("id", "repo_id", "type", "name", "file_path", "language", "line_start", "file_hash")


@query(f"WITH {E} SELECT id, source_id, target_id, relation, confidence, weight, seq FROM e")
def upsert_edges(spark, d):
    return _edges(spark, d).select("id", "source_id", "target_id", "relation", "confidence", "weight", "seq")


@query(f"WITH {NE} SELECT id, seq FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def referenced_edges(spark, d):
    return st.referenced_edges(_edges(spark, d), _nodes(spark, d)).select("id", "seq")


@query(f"WITH {N} SELECT repo_id, lower(language) AS language, count(*) AS n FROM n GROUP BY ALL")
def stats_by_language(spark, d):
    return st.counts_by(_nodes(spark, d).withColumn("language", F.lower("language")), "repo_id", "language")


@query(f"WITH {N} SELECT repo_id, type, count(*) AS n FROM n GROUP BY ALL")
def stats_by_type(spark, d):
    return st.counts_by(_nodes(spark, d), "repo_id", "type")


@query(f"WITH {E} SELECT repo_id, relation, count(*) AS n FROM e GROUP BY ALL")
def stats_by_relation(spark, d):
    return st.counts_by(_edges(spark, d), "repo_id", "relation")


@query(f"""WITH {NE}, f AS (SELECT repo_id, type, count(*) AS c FROM n WHERE type IS NOT NULL GROUP BY ALL), r AS (SELECT repo_id, relation, count(*) AS c FROM e WHERE relation IS NOT NULL GROUP BY ALL)
SELECT p.id AS repo_id, p.name, p.status, (SELECT count(*) FROM n WHERE n.repo_id = p.id) AS n_nodes, (SELECT count(*) FROM e WHERE e.repo_id = p.id) AS n_edges,
coalesce((SELECT string_agg(type || '=' || c, ',' ORDER BY type) FROM f WHERE f.repo_id = p.id), '') AS node_types, coalesce((SELECT string_agg(relation || '=' || c, ',' ORDER BY relation) FROM r WHERE r.repo_id = p.id), '') AS relations FROM repos p""")
def repo_stats(spark, d):
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias(c)
    r = st.repo_stats(table(spark, d, "repos"), _nodes(spark, d), _edges(spark, d))
    return r.select("repo_id", "name", "status", "n_nodes", "n_edges", flat("node_types"), flat("relations"))


@query("SELECT id, name, status, row_number() OVER (ORDER BY last_indexed DESC NULLS LAST, id)::INTEGER AS place FROM repos")
def list_repos(spark, d):
    return st.recent_repos(table(spark, d, "repos"))


@query(f"WITH {NE} SELECT id, status, (SELECT count(*) FROM n WHERE n.repo_id = p.id) AS node_count, (SELECT count(*) FROM e WHERE e.repo_id = p.id) AS edge_count FROM repos p")
def refresh_counts(spark, d):
    return st.refresh_repos(table(spark, d, "repos"), _nodes(spark, d), _edges(spark, d)).select("id", "status", "node_count", "edge_count")


@query(f"WITH {N} SELECT repo_id, file_path, min(language) AS language, count(*) AS n_nodes FROM n GROUP BY ALL")
def list_files(spark, d):
    return st.list_files(_nodes(spark, d))


@query(f"WITH {N} SELECT repo_id, file_path, min(language) AS language, count(*) AS n_nodes FROM n WHERE lower(language) = 'python' GROUP BY ALL")
def list_files_filtered(spark, d):
    return st.list_files(_nodes(spark, d), "python")


@query(f"WITH {N} SELECT repo_id, file_path, type, count(*) AS n, string_agg(name, ' ' ORDER BY coalesce(line_start, -1), id) AS names FROM n GROUP BY ALL")
def find_by_file(spark, d):
    return st.files_by_type(_nodes(spark, d))


@query(f"WITH {NE}, o AS (SELECT source_id AS id, count(*) AS c FROM e GROUP BY 1), i AS (SELECT target_id AS id, count(*) AS c FROM e WHERE target_id IS NOT NULL GROUP BY 1) SELECT id, n.type, n.name, n.file_path, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id)")
def node_detail(spark, d):
    return st.node_details(_nodes(spark, d), _edges(spark, d))


@query(f"WITH {NE}, {TOP_SOURCE.format(k=5)} SELECT source_id AS id, 'out' AS direction, target_id AS other, relation, seq FROM e WHERE source_id IN (SELECT id FROM start) UNION ALL SELECT target_id, 'in', source_id, relation, seq FROM e WHERE target_id IN (SELECT id FROM start)")
def node_edges(spark, d):
    return st.edge_lists(_edges(spark, d), _busiest_source(spark, d, 5))


@query(f"WITH {N} SELECT file_path, count(*) AS n FROM n WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY n DESC, file_path LIMIT 1")
def busiest_file(spark, d):
    return st.top_by(_nodes(spark, d), "file_path")


@query(f"WITH {E} SELECT source_id, count(*) AS n FROM e WHERE source_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, source_id LIMIT 10")
def busiest_source(spark, d):
    return st.top_by(_edges(spark, d), "source_id", 10)


@query(f"WITH {N} SELECT repo_id, file_path, arg_max(file_hash, (coalesce(updated_at, TIMESTAMPTZ '1000-01-01'), id)) AS file_hash FROM n WHERE type = 'file' GROUP BY ALL")
def file_hashes(spark, d):
    return st.file_hashes(_nodes(spark, d))


@query(f"""WITH {N}, k AS (SELECT repo_id, lower(name) AS key, id, ord, TRUE AS whole FROM n UNION ALL SELECT repo_id, lower(list_last(string_split(name, '::'))), id, ord, FALSE FROM n)
SELECT repo_id, key, coalesce(arg_max(id, (ord, id)) FILTER (whole), arg_min(id, (ord, id)) FILTER (NOT whole)) AS id FROM k WHERE key IS NOT NULL AND key <> '' GROUP BY ALL""")
def name_index(spark, d):
    return st.name_index(_nodes(spark, d))


def _raw_calls(spark, d):
    """Calls of the edges table as an extractor delivers them: by the name of what is called."""
    e = table(spark, d, "edges").where("relation = 'calls'")
    return e.select("repo_id", F.col("source_id").alias("src"), F.lit(None).cast("string").alias("tgt"), F.element_at(F.split("target_id", "::"), -1).alias("tgt_name"), "relation", "confidence", F.col("source_line").alias("line"), "seq")


@query(f"""WITH {N}, k AS (SELECT repo_id, lower(name) AS key, id, ord, TRUE AS whole FROM n UNION ALL SELECT repo_id, lower(list_last(string_split(name, '::'))), id, ord, FALSE FROM n),
ix AS (SELECT repo_id, key, coalesce(arg_max(id, (ord, id)) FILTER (whole), arg_min(id, (ord, id)) FILTER (NOT whole)) AS id FROM k WHERE key IS NOT NULL AND key <> '' GROUP BY ALL),
raw AS (SELECT repo_id, source_id AS src, lower(list_last(string_split(target_id, '::'))) AS key, relation, seq FROM edges WHERE relation = 'calls'),
hit AS (SELECT raw.src, ix.id AS tgt, raw.relation, raw.seq FROM raw JOIN ix USING (repo_id, key) WHERE raw.src IS NOT NULL AND raw.src <> ix.id)
SELECT src || '::' || relation || '::' || tgt AS id, src AS source_id, tgt AS target_id, max(seq) AS seq FROM hit GROUP BY ALL""")
def resolve_edges(spark, d):
    return st.resolve_edges(_raw_calls(spark, d), st.name_index(_nodes(spark, d))).select("id", "source_id", "target_id", "seq")


@query(f"""WITH {N}, k AS (SELECT repo_id, lower(name) AS key, id, ord, TRUE AS whole FROM n UNION ALL SELECT repo_id, lower(list_last(string_split(name, '::'))), id, ord, FALSE FROM n),
ix AS (SELECT repo_id, key, coalesce(arg_max(id, (ord, id)) FILTER (whole), arg_min(id, (ord, id)) FILTER (NOT whole)) AS id FROM k WHERE key IS NOT NULL AND key <> '' GROUP BY ALL),
raw AS (SELECT repo_id, source_id AS src, CASE WHEN relation = 'contains' THEN target_id END AS tgt, lower(list_last(string_split(target_id, '::'))) AS key, relation, seq FROM edges),
hit AS (SELECT raw.src, coalesce(raw.tgt, ix.id) AS tgt, raw.relation, raw.seq FROM raw LEFT JOIN ix USING (repo_id, key) WHERE raw.src IS NOT NULL)
SELECT src || '::' || relation || '::' || tgt AS id, src AS source_id, tgt AS target_id, max(seq) AS seq FROM hit WHERE tgt IS NOT NULL AND src <> tgt AND relation IS NOT NULL GROUP BY ALL""")
def resolve_all_edges(spark, d):
    """Every edge resolved anew by the name of its target; those of containment carry their target's id."""
    e = table(spark, d, "edges").where("relation IS NOT NULL")
    tgt = F.when(F.col("relation") == "contains", F.col("target_id"))
    raw = e.select("repo_id", F.col("source_id").alias("src"), tgt.alias("tgt"), F.element_at(F.split("target_id", "::"), -1).alias("tgt_name"), "relation", "confidence", F.col("source_line").alias("line"), "seq")
    return st.resolve_edges(raw, st.name_index(_nodes(spark, d))).select("id", "source_id", "target_id", "seq")


@query(f"WITH {N} SELECT id, len(metadata.decorators) AS n, array_to_string(metadata.decorators, ',') AS decorators FROM n WHERE len(metadata.decorators) > 0")
def decorated_nodes(spark, d):
    x = F.col("metadata.decorators")
    return _nodes(spark, d).where(F.size(x) > 0).select("id", F.size(x).cast("bigint").alias("n"), F.array_join(x, ",").alias("decorators"))


@query(f"WITH {N} SELECT id, concat_ws('::', repo_id, file_path, CASE WHEN type <> 'file' THEN name END) AS built, list_last(string_split(name, '::')) AS short FROM n")
def node_ids(spark, d):
    """Ids and short names as they are built from their parts."""
    r = _code(spark, d).nodes.withColumn("member", F.when(F.col("type") != "file", F.col("name")))
    return r.select("id", node_id("repo_id", "file_path", "member").alias("built"), short_name().alias("short"))


@query(f"""WITH {N}, incoming AS (SELECT DISTINCT repo_id AS id, '/new/' || repo_id AS path, upper(repo_id) AS name FROM n WHERE repo_id > 'h' UNION ALL SELECT 'fresh', '/new/fresh', 'FRESH')
SELECT coalesce(i.id, r.id) AS id, coalesce(i.path, r.path) AS path, coalesce(i.name, r.name) AS name, CASE WHEN i.id IS NOT NULL THEN 'indexing' ELSE r.status END AS status, coalesce(r.node_count, 0) AS node_count FROM repos r FULL OUTER JOIN incoming i ON r.id = i.id""")
def upsert_repos(spark, d):
    """Repositories after some were delivered again and one came: what is delivered counts, counts stay."""
    have = _code(spark, d).nodes.where("repo_id > 'h'").select(F.col("repo_id").alias("id")).distinct()
    new = have.unionByName(spark.createDataFrame([("fresh",)], "id string"))
    new = new.select("id", F.concat(F.lit("/new/"), "id").alias("path"), F.upper("id").alias("name"), F.lit("indexing").alias("status"))
    return st.upsert_repos(table(spark, d, "repos"), new).select("id", "path", "name", "status", "node_count")


@query(f"""WITH {NE}, m AS (SELECT max(last_indexed) AS at FROM repos) SELECT id, 'ready' AS status, (SELECT count(*) FROM n WHERE n.repo_id = p.id) AS node_count, (SELECT count(*) FROM e WHERE e.repo_id = p.id) AS edge_count FROM repos p WHERE id < 'h'
UNION ALL SELECT id, status, coalesce(node_count, 0), coalesce(edge_count, 0) FROM repos WHERE id >= 'h'""")
def index_status(spark, d):
    """Repositories after some of them were indexed: status, time and counts of those are new."""
    c = _code(spark, d)
    repos = table(spark, d, "repos")
    done = repos.where("id < 'h'").select("id")
    return st.finish_repos(repos, done, c.nodes, c.edges).select("id", "status", "node_count", "edge_count")


@query(f"WITH {NE}, gone AS (SELECT DISTINCT repo_id, file_path FROM n WHERE lower(language) = 'go') SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo_id = n.repo_id AND g.file_path = n.file_path)")
def delete_by_file(spark, d):
    """Nodes after some files were deleted."""
    n = _code(spark, d).nodes
    return st.delete_files(n, n.where("lower(language) = 'go'").select("repo_id", "file_path")).select("id")


@query(f"""WITH {NE}, a AS (SELECT repo_id, 'nodes' AS metric, '{{{{"value":' || count(*) || '}}}}' AS value_json FROM n GROUP BY repo_id UNION ALL SELECT repo_id, 'edges', '{{{{"value":' || count(*) || '}}}}' FROM e GROUP BY repo_id)
SELECT repo_id, metric, value_json FROM a""".replace("{{", "{").replace("}}", "}"))
def saved_metrics(spark, d):
    """Metrics that were saved twice: the later ones count."""
    c = _code(spark, d)
    m = lambda rows, name: rows.groupBy("repo_id").agg(F.to_json(F.struct(F.count("*").alias("value"))).alias("value_json")).select("repo_id", F.lit(name).alias("metric"), "value_json")
    new = m(c.nodes, "nodes").unionByName(m(c.edges, "edges"))
    old = new.withColumns({"value_json": F.lit("{}"), "computed_at": F.to_timestamp(F.lit("2020-01-01"))})
    return st.upsert_metrics(old, new.withColumn("computed_at", F.to_timestamp(F.lit("2020-01-02")))).select("repo_id", "metric", "value_json")


@query(f"""WITH {N}, f AS (SELECT DISTINCT repo_id, file_path FROM n WHERE file_path IS NOT NULL), fl AS (SELECT repo_id, string_agg(file_path, ' ' ORDER BY file_path) AS files FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS k FROM f) WHERE k <= 20 GROUP BY 1),
nl AS (SELECT repo_id, string_agg(name, ' / ' ORDER BY length(name), name, id) AS label FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY length(name), name, id) AS k FROM n WHERE name IS NOT NULL) WHERE k <= 3 GROUP BY 1),
il AS (SELECT repo_id, string_agg(id, ' ' ORDER BY id) AS nodes FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY id) AS k FROM n) WHERE k <= 50 GROUP BY 1)
SELECT repo_id AS community, (SELECT count(*) FROM n WHERE n.repo_id = il.repo_id) AS size, label, files, nodes FROM il JOIN fl USING (repo_id) JOIN nl USING (repo_id)""")
def group_report(spark, d):
    """The report on communities, with the repositories as groups: labels of the three shortest names, the first files and nodes."""
    g = _code(spark, d).graph
    r = al.community_report(g, g.vertices.where("repo_id IS NOT NULL").select("id", F.col("repo_id").alias("community")))
    return r.select("community", "size", "label", F.array_join("files", " ").alias("files"), F.array_join("nodes", " ").alias("nodes"))


@query("""WITH events_in AS (SELECT name AS repository FROM repos WHERE id < 'f' UNION ALL SELECT id FROM repos WHERE id > 'm' UNION ALL SELECT 'nobody'),
hit AS (SELECT repository, min(id) FILTER (id = repository) AS by_id, min(id) FILTER (name = repository) AS by_name FROM events_in JOIN repos ON id = repository OR name = repository GROUP BY 1)
SELECT DISTINCT coalesce(by_id, by_name) AS id FROM hit""")
def pushed_repos(spark, d):
    """Repositories that push events speak of, by id or by name."""
    repos = table(spark, d, "repos")
    events = repos.where("id < 'f'").select(F.col("name").alias("repository")).unionByName(repos.where("id > 'm'").select(F.col("id").alias("repository"))).unionByName(spark.createDataFrame([("nobody",)], "repository string"))
    return si.pushed_repos(events, repos).select("id")


# -- files and increments -----------------------------------------------------------------------------------------------
_FILES = "files AS (SELECT DISTINCT file_id, repo_id, file_path, content FROM source_files)"
_EXCLUDED = "(" + " OR ".join(f"contains('/' || file_path || '/', '/{p}/')" for p in fi.DEFAULT_EXCLUDES) + " OR contains('/' || file_path || '/', '/web/vendor/') OR list_contains(string_split(file_path, '/'), 'generated_reports'))"
_SUFFIX = "(" + " OR ".join(f"ends_with(lower(file_path), '{x}')" for x in fi.EXCLUDED_SUFFIXES) + ")"


def _files(spark, d):
    return table(spark, d, "source_files").select("file_id", "repo_id", "file_path", "content").dropDuplicates(["file_id"])


@query(f"WITH {_FILES} SELECT file_id FROM files WHERE {_EXCLUDED}")
def exclude_filter(spark, d):
    return _files(spark, d).where(fi.excluded("file_path", [*fi.DEFAULT_EXCLUDES, "web/vendor", "**/generated_reports/**"])).select("file_id")


@query(f"WITH {_FILES} SELECT file_id FROM files WHERE {_SUFFIX}")
def suffix_filter(spark, d):
    return _files(spark, d).where(fi.suffix_excluded("file_path")).select("file_id")


@query(f"WITH {_FILES} SELECT file_id, {{}} FROM files".format("CASE " + " ".join(f"WHEN lower(list_last(string_split(file_path, '.'))) = '{k}' THEN '{v}'" for k, v in fi.EXTENSIONS.items()) + " END AS language"))
def detect_language(spark, d):
    return _files(spark, d).select("file_id", fi.language_of("file_path").alias("language"))


@query(f"WITH {_FILES} SELECT file_id, md5(content) AS file_hash FROM files WHERE content IS NOT NULL")
def file_hash(spark, d):
    return _files(spark, d).where("content IS NOT NULL").select("file_id", F.md5("content").alias("file_hash"))


_STATE = f"""{N}, {_FILES}, old AS (SELECT repo_id, file_path, arg_max(file_hash, (coalesce(updated_at, TIMESTAMPTZ '1000-01-01'), id)) AS file_hash FROM n WHERE type = 'file' GROUP BY ALL),
cur AS (SELECT repo_id, file_path, md5(content) AS file_hash FROM files WHERE content IS NOT NULL AND NOT {_SUFFIX} AND NOT {_EXCLUDED})"""


def _increment(spark, d):
    now = _files(spark, d).where("content IS NOT NULL").where(~fi.suffix_excluded("file_path") & ~fi.excluded("file_path", [*fi.DEFAULT_EXCLUDES, "web/vendor", "**/generated_reports/**"]))
    return fi.file_states(now.select("repo_id", "file_path", F.md5("content").alias("file_hash")), st.file_hashes(_nodes(spark, d)))


@query(f"""WITH {_STATE} SELECT coalesce(c.repo_id, o.repo_id) AS repo_id, coalesce(c.file_path, o.file_path) AS file_path,
CASE WHEN o.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'stale' WHEN c.file_hash IS DISTINCT FROM o.file_hash THEN 'changed' ELSE 'skipped' END AS state FROM cur c FULL OUTER JOIN old o ON c.repo_id = o.repo_id AND c.file_path = o.file_path""")
def incremental_states(spark, d):
    return _increment(spark, d)


@query(f"""WITH {_STATE}, s AS (SELECT CASE WHEN o.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'stale' WHEN c.file_hash IS DISTINCT FROM o.file_hash THEN 'changed' ELSE 'skipped' END AS state FROM cur c FULL OUTER JOIN old o ON c.repo_id = o.repo_id AND c.file_path = o.file_path) SELECT state, count(*) AS n FROM s GROUP BY 1""")
def incremental_counts(spark, d):
    return _increment(spark, d).groupBy("state").agg(F.count("*").alias("n"))


# -- graph ----------------------------------------------------------------------------------------------------------------
@query(f"WITH {NEA} SELECT src, dst, relation, confidence, weight, seq FROM arcs")
def collapse_arcs(spark, d):
    return _graph(spark, d).arcs


@query(f"WITH {N.replace('WHERE id IS NOT NULL', 'WHERE id IS NOT NULL').replace('WHERE rn = 1', chr(87) + 'HERE rn = 1 AND type IN (' + chr(39) + 'function' + chr(39) + ', ' + chr(39) + 'class' + chr(39) + ')')}, {E}, {ARCS.format(filter='AND relation IN (' + chr(39) + 'calls' + chr(39) + ', ' + chr(39) + 'method' + chr(39) + ')')} SELECT src, dst, relation FROM arcs")
def load_graph_filtered(spark, d):
    return _graph(spark, d, types=["function", "class"], relations=["calls", "method"]).arcs.select("src", "dst", "relation")


@query(f"WITH {NE} SELECT CASE WHEN target_id IS NULL THEN 'unresolved' WHEN source_id NOT IN (SELECT id FROM n) THEN 'unknown source' ELSE 'unknown target' END AS reason, count(*) AS n FROM e WHERE target_id IS NULL OR source_id NOT IN (SELECT id FROM n) OR target_id NOT IN (SELECT id FROM n) GROUP BY 1")
def skipped_edges(spark, d):
    return gr.skipped_edges(_graph(spark, d), _edges(spark, d))


def _bfs(start: str, a: str, b: str, depth: int, filter: str = "") -> str:
    step = f"SELECT * FROM arcs {filter}"
    return f"""WITH RECURSIVE {NEA}, {start}, step AS ({step}),
    walk(start, id, depth) AS (SELECT s.id, t.{b}, 1 FROM start s JOIN step t ON t.{a} = s.id UNION SELECT w.start, t.{b}, w.depth + 1 FROM walk w JOIN step t ON t.{a} = w.id WHERE w.depth < {depth}),
    near AS (SELECT start, id, min(depth) AS depth FROM walk GROUP BY ALL), prior AS (SELECT start, id, depth FROM near UNION ALL SELECT id, id, 0 FROM start)
    SELECT x.start, x.id, x.depth::INTEGER AS depth, arg_min(t.relation, t.seq) AS relation, arg_min(t.weight, t.seq) AS weight, any_value(n.name) AS name
    FROM near x JOIN prior p ON p.start = x.start AND p.depth = x.depth - 1 JOIN step t ON t.{a} = p.id AND t.{b} = x.id JOIN n ON n.id = x.id GROUP BY x.start, x.id, x.depth"""


def _reach_columns(r):
    return r.select("start", "id", "depth", "relation", "weight", "name")


@query(_bfs(TOP_SOURCE.format(k=3), "src", "dst", 1))
def dependencies_d1(spark, d):
    return _reach_columns(gr.dependencies(_code(spark, d).graph, _busiest_source(spark, d, 3), 1))


@query(_bfs(TOP_SOURCE.format(k=3), "src", "dst", 3))
def dependencies_d3(spark, d):
    return _reach_columns(gr.dependencies(_code(spark, d).graph, _busiest_source(spark, d, 3), 3))


@query("SELECT start, id, depth, row_number() OVER (PARTITION BY start ORDER BY depth, name, id)::INTEGER AS place FROM (" + _bfs(TOP_SOURCE.format(k=3), "src", "dst", 2) + ")")
def dependencies_ordered(spark, d):
    """Dependencies in the order of an answer: by depth and name."""
    r = gr.dependencies(_code(spark, d).graph, _busiest_source(spark, d, 3), 2)
    return r.select("start", "id", "depth", F.row_number().over(Window.partitionBy("start").orderBy("depth", "name", "id")).alias("place"))


@query(_bfs(TOP_SOURCE.format(k=3), "src", "dst", 3, "WHERE relation IN ('calls', 'imports')"))
def dependencies_filtered(spark, d):
    return _reach_columns(gr.dependencies(_code(spark, d).graph, _busiest_source(spark, d, 3), 3, ["calls", "imports"]))


@query(_bfs(TOP_TARGET.format(k=3), "dst", "src", 2))
def dependents_d2(spark, d):
    return _reach_columns(gr.dependents(_code(spark, d).reverse, _busiest_target(spark, d, 3), 2))


@query(_bfs(TOP_TARGET.format(k=1), "dst", "src", 3))
def impact_d3(spark, d):
    return _reach_columns(gr.impact(_code(spark, d).reverse, _busiest_target(spark, d), 3))


@query(_bfs(TOP_TARGET.format(k=1), "dst", "src", 3).replace("SELECT x.start, x.id", "SELECT q.start, n2.file_path, count(*) AS n, min(q.depth) AS depth FROM (SELECT x.start, x.id") + ") q JOIN n n2 ON n2.id = q.id GROUP BY ALL")
def impact_by_file(spark, d):
    return gr.impact_by_file(gr.impact(_code(spark, d).reverse, _busiest_target(spark, d), 3))


@query(f"""WITH RECURSIVE {NEA}, {TOP_SOURCE.format(k=1)}, both_ways AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs), walk(id, depth) AS (SELECT id, 0 FROM start UNION SELECT b.dst, w.depth + 1 FROM walk w JOIN both_ways b ON b.src = w.id WHERE w.depth < 2), near AS (SELECT DISTINCT id FROM walk)
SELECT src, dst, relation FROM arcs WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)""")
def ego_subgraph(spark, d):
    return gr.ego(_code(spark, d).graph, _busiest_source(spark, d), 2).arcs.select("src", "dst", "relation")


@query(f"""WITH {NEA}, f AS (SELECT repo_id, file_path FROM n WHERE file_path IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, repo_id, file_path LIMIT 1), mine AS (SELECT id FROM n JOIN f USING (repo_id, file_path)),
near AS (SELECT id FROM mine UNION SELECT dst FROM arcs WHERE src IN (SELECT id FROM mine) UNION SELECT src FROM arcs WHERE dst IN (SELECT id FROM mine))
SELECT src, dst, relation FROM arcs WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)""")
def file_subgraph(spark, d):
    g = _code(spark, d).graph
    row = g.vertices.where("file_path IS NOT NULL").groupBy("repo_id", "file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo_id", "file_path").first()
    return gr.file_subgraph(g, row[0] if row else "", row[1] if row else "").arcs.select("src", "dst", "relation")


@query(f"""WITH {NEA}, p AS (SELECT DISTINCT a.src AS a, a.dst AS b FROM arcs a JOIN arcs r ON a.src = r.dst AND a.dst = r.src)
SELECT a, b, '->' AS direction, relation, confidence FROM arcs JOIN p ON src = a AND dst = b UNION ALL SELECT a, b, '<-', relation, confidence FROM arcs JOIN p ON src = b AND dst = a""")
def edges_between(spark, d):
    g = _code(spark, d).graph
    back = g.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = g.arcs.select("src", "dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return gr.edges_between(g, pairs)


@query(f"WITH {NEA}, {DEGREES} SELECT id, in_degree, in_plain, out_degree, out_plain FROM deg")
def degrees(spark, d):
    return gr.degrees(_code(spark, d).graph).select("id", "in_degree", "in_plain", "out_degree", "out_plain")


@query(f"WITH {NEA}, {DEGREES} SELECT id, name, type, file_path, out_degree FROM deg WHERE in_plain = 0 AND type IN ('function', 'class')")
def entry_points(spark, d):
    return gr.entry_points(_code(spark, d).graph)


@query(f"WITH {NEA}, {DEGREES} SELECT id, name, type, file_path, in_degree FROM deg WHERE out_degree = 0 AND type IN ('function', 'class')")
def dead_ends(spark, d):
    return gr.dead_ends(_code(spark, d).graph)


@query(f"WITH {NEA}, {DEGREES} SELECT id, name, in_plain AS in_degree, out_degree, in_plain + out_degree AS coupling_score FROM deg WHERE in_plain >= 8 AND out_degree >= 8")
def god_objects(spark, d):
    return gr.god_objects(_code(spark, d).graph).select("id", "name", "in_degree", "out_degree", "coupling_score")


@query(f"WITH {lenses.HANDOFF_SQL}, i AS (SELECT dst AS id, count(*) AS a FROM handoff GROUP BY 1), o AS (SELECT src AS id, count(*) AS b FROM handoff GROUP BY 1) SELECT id, a AS in_degree, b AS out_degree, a + b AS coupling_score FROM i JOIN o USING (id) WHERE a >= 8 AND b >= 8")
def god_objects_handoff(spark, d):
    return gr.god_objects(lenses.handoff(spark, d)).select("id", "in_degree", "out_degree", "coupling_score")


@query(f"WITH {NEA}, {DEGREES} SELECT id, (in_plain + out_plain)::DOUBLE AS score, in_plain AS in_degree, out_degree FROM deg ORDER BY score DESC, id LIMIT 20")
def critical_degree(spark, d):
    return gr.critical_by_degree(_code(spark, d).graph, 20).select("id", "score", "in_degree", "out_degree")


# -- paths, cycles, centrality, communities ---------------------------------------------------------------------------------
_SIMPLE = """p(s, t, cost, hops, path) AS (SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey, 0, 0, ['nation:' || n_nationkey] FROM nation
  UNION ALL SELECT p.s, a.dst, p.cost + a.{cost}, p.hops + 1, list_append(p.path, a.dst) FROM p JOIN trade a ON a.src = p.t WHERE p.hops < 9 AND NOT list_contains(p.path, a.dst))"""


@query(f"""WITH RECURSIVE {lenses.TRADE_SQL}, {_SIMPLE.format(cost="cost")}, b AS (SELECT s, t, min((cost, hops, path)) AS m FROM p GROUP BY ALL)
SELECT s AS source, t AS target, m[1]::INTEGER AS cost, m[2]::INTEGER AS length, array_to_string(m[3], '>') AS path FROM b""")
def shortest_paths(spark, d):
    g = lenses.trade(spark, d).stored("trade")
    return al.shortest_paths(g, g.vertices.select("id")).select("source", "target", "cost", "length", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {lenses.TRADE_SQL}, c(first, last, nodes) AS (SELECT src, dst, [src, dst] FROM trade WHERE src < dst
  UNION ALL SELECT c.first, a.dst, list_append(c.nodes, a.dst) FROM c JOIN trade a ON a.src = c.last WHERE a.dst > c.first AND NOT list_contains(c.nodes, a.dst)),
closed AS (SELECT DISTINCT nodes FROM c JOIN trade a ON a.src = c.last AND a.dst = c.first)
SELECT len(nodes)::INTEGER AS length, array_to_string(nodes, '>') AS nodes FROM (SELECT * FROM closed ORDER BY len(nodes), nodes LIMIT 20)""")
def cycles_top20(spark, d):
    return al.cycles(lenses.trade(spark, d).stored("trade"), 20).select("length", F.array_join("nodes", ">").alias("nodes"))


@query(f"""WITH RECURSIVE {lenses.TRADE_SQL}, {_SIMPLE.format(cost="dist")}, b AS (SELECT s, t, min(cost) AS cost FROM p WHERE s <> t GROUP BY ALL), q AS (SELECT p.s, p.t, path FROM p JOIN b ON p.s = b.s AND p.t = b.t AND p.cost = b.cost),
k AS (SELECT s, t, count(*) AS k FROM q GROUP BY ALL), v AS (SELECT q.s, q.t, unnest(path) AS id FROM q), h AS (SELECT id, sum(1.0::DOUBLE / k.k) AS x FROM v JOIN k ON v.s = k.s AND v.t = k.t WHERE id <> v.s AND id <> v.t GROUP BY id),
c AS (SELECT count(*) AS n FROM nation) SELECT 'nation:' || n_nationkey AS id, round(coalesce(x, 0) / ((c.n - 1) * (c.n - 2)), 6) AS score FROM nation LEFT JOIN h ON h.id = 'nation:' || n_nationkey CROSS JOIN c""")
def betweenness(spark, d):
    return al.betweenness(lenses.trade(spark, d).stored("trade"))


@query(f"""WITH RECURSIVE {NEA}, {TOP_SOURCE.format(k=5)}, steps AS MATERIALIZED (SELECT src, dst, CASE confidence WHEN 'EXTRACTED' THEN 14 WHEN 'INFERRED' THEN 20 WHEN 'AMBIGUOUS' THEN 35 ELSE 28 END AS c FROM arcs),
p(source, target, best) USING KEY (source, target) AS (SELECT id, id, (0, 0, [id]) FROM start UNION
  SELECT p.source, s.dst, min((p.best[1] + s.c, p.best[2] + 1, list_append(p.best[3], s.dst))) AS b FROM p JOIN steps s ON s.src = p.target LEFT JOIN recurring.p AS r ON r.source = p.source AND r.target = s.dst
  WHERE r.source IS NULL OR (p.best[1] + s.c, p.best[2] + 1, list_append(p.best[3], s.dst)) < r.best GROUP BY p.source, s.dst)
SELECT source, target, best[1]::INTEGER AS cost, best[2]::INTEGER AS length, array_to_string(best[3], '>') AS path FROM p""")
def shortest_paths_code(spark, d):
    """Cheapest paths from the five busiest sources over the whole code graph."""
    g = _code(spark, d).graph
    return al.shortest_paths(g, _busiest_source(spark, d, 5)).select("source", "target", "cost", "length", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {NEA}, own AS MATERIALIZED (SELECT src, dst, relation, CASE confidence WHEN 'EXTRACTED' THEN 10 WHEN 'INFERRED' THEN 7 WHEN 'AMBIGUOUS' THEN 4 ELSE 5 END AS c, s.repo_id FROM arcs JOIN n s ON s.id = src JOIN n t ON t.id = dst WHERE s.repo_id = t.repo_id),
p(s, t, cost) USING KEY (s, t) AS (SELECT id, id, 0 FROM n UNION SELECT p.s, o.dst, min(p.cost + o.c) FROM p JOIN own o ON o.src = p.t LEFT JOIN recurring.p AS r ON r.s = p.s AND r.t = o.dst WHERE o.src <> o.dst AND (r.s IS NULL OR p.cost + o.c < r.cost) GROUP BY p.s, o.dst),
q(s, t, cost, path) AS (SELECT id, id, 0, [id] FROM n UNION ALL SELECT q.s, o.dst, q.cost + o.c, list_append(q.path, o.dst) FROM q JOIN own o ON o.src = q.t JOIN p ON p.s = q.s AND p.t = o.dst WHERE q.cost + o.c = p.cost AND o.src <> o.dst),
k AS (SELECT s, t, count(*) AS k FROM q WHERE s <> t GROUP BY ALL), v AS (SELECT s, t, unnest(path[2:-2]) AS id FROM q WHERE len(path) > 2),
h AS (SELECT id, sum(1.0::DOUBLE / k.k) AS x FROM v JOIN k USING (s, t) GROUP BY id), c AS (SELECT repo_id, count(*) AS m FROM n GROUP BY 1),
di AS (SELECT dst AS id, count(*) AS a FROM own GROUP BY 1), dd AS (SELECT src AS id, count(*) AS a FROM own GROUP BY 1),
r AS (SELECT n.repo_id, n.id, CASE WHEN m > 2 THEN round(coalesce(x, 0) / ((m - 1) * (m - 2)), 6) ELSE 0.0 END AS score, 'betweenness' AS method, coalesce(di.a, 0) AS in_degree, coalesce(dd.a, 0) AS out_degree FROM n JOIN c USING (repo_id) LEFT JOIN h ON h.id = n.id LEFT JOIN di ON di.id = n.id LEFT JOIN dd ON dd.id = n.id)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, id) <= 20""")
def critical_nodes(spark, d):
    """Of every repository, the vertices that matter most, each repository a graph of its own. The SQL holds where no repository has more vertices than there are pivots."""
    return al.critical_by_repo(_code(spark, d).graph).select("repo_id", "id", "score", "method", "in_degree", "out_degree")


@query(f"""WITH RECURSIVE {NEA}, reach(s, t) AS (SELECT src, dst FROM arcs UNION SELECT reach.s, a.dst FROM reach JOIN arcs a ON a.src = reach.t), ring AS MATERIALIZED (SELECT src, dst FROM arcs JOIN reach ON s = dst AND t = src WHERE src <> dst),
c(first, last, nodes) AS (SELECT src, dst, [src, dst] FROM ring WHERE src < dst UNION ALL SELECT c.first, a.dst, list_append(c.nodes, a.dst) FROM c JOIN ring a ON a.src = c.last WHERE a.dst > c.first AND NOT list_contains(c.nodes, a.dst)),
closed AS (SELECT DISTINCT nodes FROM c JOIN ring a ON a.src = c.last AND a.dst = c.first)
SELECT len(nodes)::INTEGER AS length, array_to_string(nodes, '>') AS nodes FROM (SELECT * FROM closed ORDER BY len(nodes), nodes LIMIT 20)""")
def cycles_code(spark, d):
    """The twenty shortest cycles of the whole code graph."""
    return al.cycles(_code(spark, d).graph, 20).select("length", F.array_join("nodes", ">").alias("nodes"))


@query(f"""WITH RECURSIVE {NE}, {ARCS.format(filter="AND relation IN ('inherits', 'method')")}, b AS (SELECT src, dst FROM arcs WHERE src <> dst UNION SELECT dst, src FROM arcs WHERE src <> dst), w(id, r) AS (SELECT id, id FROM n UNION SELECT w.id, b.dst FROM w JOIN b ON b.src = w.r) SELECT id, min(r) AS component FROM w GROUP BY 1""")
def connected_components(spark, d):
    return al.connected_components(_graph(spark, d, relations=["inherits", "method"]))


@query(f"""WITH RECURSIVE {NEA}, b AS MATERIALIZED (SELECT src, dst FROM arcs WHERE src <> dst UNION SELECT dst, src FROM arcs WHERE src <> dst),
cc(id, component) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT b.dst, min(cc.component) FROM cc JOIN b ON b.src = cc.id JOIN recurring.cc AS r ON r.id = b.dst WHERE cc.component < r.component GROUP BY b.dst)
SELECT id, component FROM cc""")
def connected_components_all(spark, d):
    """Components of the whole graph, over all relations."""
    return al.connected_components(_code(spark, d).graph)


@query()
def communities(spark, d):
    """Communities of the whole graph, which needs no more of what is stored than the nodes."""
    nodes = _nodes(spark, d).select("id", "repo_id", "type", "name", "file_path", "language")
    ends = table(spark, d, "edges").select("id", "source_id", "target_id", "relation", "confidence", "seq")
    g = gr.load_graph(kept(nodes, "vertices"), st.latest_edges(ends))
    return al.community_report(g, al.communities(g, 3)).select("community", "size", "label")


# -- search ----------------------------------------------------------------------------------------------------------------
_WORDS = """words AS (SELECT id, col, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT id, col, list_filter(string_split_regex(translate(lower(coalesce(txt, '')), '{a}', '{p}'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '') AS t FROM
  (SELECT id, 'name' AS col, name AS txt FROM n UNION ALL SELECT id, 'docstring', docstring FROM n UNION ALL SELECT id, 'file_path', file_path FROM n))),
lengths AS (SELECT n.id, coalesce(k, 0) AS len FROM n LEFT JOIN (SELECT id, count(*) AS k FROM words GROUP BY 1) USING (id)), total AS (SELECT count(*) AS n, avg(len) AS mean FROM lengths)"""


def _search_sql(hits: str, limit: int, kind: str = "", within: str = "") -> str:
    return f"""WITH {N}, {_WORDS.format(a=ACCENTED, p=PLAIN)}, hits AS ({hits}), df AS (SELECT count(*) AS c FROM hits),
    idf AS (SELECT CASE WHEN ln((n - c + 0.5) / (c + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - c + 0.5) / (c + 0.5)) END AS v FROM total, df),
    best AS (SELECT h.id, -v * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) AS rank FROM hits h JOIN lengths USING (id), idf, total {within} ORDER BY rank, id LIMIT {3 * limit})
    SELECT id, round(rank, 9) AS rank FROM best JOIN n USING (id) {kind} ORDER BY best.rank, id LIMIT {limit}"""


def _search(spark, d, q, limit, kind=None):
    c = _code(spark, d)
    return se.search(c.index, c.nodes, q, limit, kind).select("id", F.round("rank", 9).alias("rank"))


@query(_search_sql("SELECT id, count(*)::DOUBLE AS f FROM words WHERE starts_with(term, 'catal') GROUP BY 1", 20))
def search_prefix(spark, d):
    return _search(spark, d, "catal", 20)


@query(_search_sql("SELECT a.id, count(*)::DOUBLE AS f FROM words a JOIN words b ON a.id = b.id AND a.col = b.col AND b.pos = a.pos + 1 JOIN words c ON a.id = c.id AND a.col = c.col AND c.pos = a.pos + 2 WHERE a.term = 'not' AND b.term = 'thread' AND c.term = 'safe' GROUP BY 1", 20))
def search_phrase(spark, d):
    return _search(spark, d, "Not thread safe", 20)


@query(f"WITH {N}, {_WORDS.format(a=ACCENTED, p=PLAIN)} SELECT id, col, term, pos::BIGINT AS pos FROM words")
def postings(spark, d):
    """The stored search index, a row per word."""
    return _code(spark, d).index.postings.select("id", "col", "term", F.col("pos").cast("bigint").alias("pos"))


@query(f"WITH {N}, {_WORDS.format(a=ACCENTED, p=PLAIN)} SELECT id, col, term, pos::BIGINT AS pos FROM words")
def postings_maintained(spark, d):
    """The index after the rows of PHP files were taken out and delivered again, and nodes that don't exist were deleted: the same as before."""
    c = _code(spark, d)
    php = c.nodes.where("lower(language) = 'php'")
    gone = php.select(F.concat("id", F.lit("::gone")).alias("id"))
    stale = se.Index(c.index.postings.withColumn("term", F.when(F.col("col") == "name", F.concat("term", F.lit("old"))).otherwise(F.col("term"))).join(php.select("id"), "id", "left_semi").unionByName(c.index.postings.join(php.select("id"), "id", "left_anti")), c.index.lengths)
    return gs.update_index(stale, php, gone).postings.select("id", "col", "term", F.col("pos").cast("bigint").alias("pos"))


@query(_search_sql("SELECT id, count(*)::DOUBLE AS f FROM words WHERE starts_with(term, 'ledger') GROUP BY 1", 20, "WHERE type = 'class'"))
def search_typed(spark, d):
    return _search(spark, d, "ledger", 20, "class")


@query("SELECT id FROM (" + _search_sql("SELECT id, count(*)::DOUBLE AS f FROM words WHERE starts_with(term, 'logger') GROUP BY 1", 1, within="WHERE h.id IN (SELECT id FROM n WHERE repo_id = 'corekit')") + ")")
def resolve_node_by_search(spark, d):
    """A name that is no id stands for the best match of a search in its repository."""
    c = _code(spark, d)
    return se.resolve_node(c.index, c.nodes, "corekit", "logger")


@query(f"WITH {N} SELECT id FROM n WHERE repo_id = 'corekit' AND id = 'corekit::src/Log/Logger.php::Logger::info'")
def resolve_node(spark, d):
    c = _code(spark, d)
    return se.resolve_node(c.index, c.nodes, "corekit", "corekit::src/Log/Logger.php::Logger::info")


def _token_sql():
    return f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(string_split_regex(translate(lower(coalesce(text, '')), '{ACCENTED}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '') AS t FROM documents)"


@query(_token_sql())
def tokenise(spark, d):
    t = search_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


# -- extraction and overviews ------------------------------------------------------------------------------------------------
@query()
def extract_sources(spark, d):
    """Nodes that extraction finds in the source files."""
    files = table(spark, d, "source_files").dropDuplicates(["file_id"])
    n = ex.extracted_nodes(ex.extract_files(files))
    return n.select("id", "type", "name", "line_start", "line_end", "docstring")


@query()
def extract_edges(spark, d):
    """Edges of the source files, resolved by name and with both ends known."""
    x = kept(ex.extract_files(table(spark, d, "source_files").dropDuplicates(["file_id"])), "extracted")
    nodes = ex.extracted_nodes(x)
    return st.referenced_edges(ig.resolve(ex.extracted_edges(x), nodes), nodes).select("id", "source_id", "target_id", "relation", "confidence")


def _values(rows: list[list[str]], columns: str) -> str:
    line = lambda r: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")"
    return f"(VALUES {', '.join(map(line, rows))}) AS v({columns})"


def _golden(spark):
    files = spark.createDataFrame([("r", path, language, text) for language, path, text in golden.SOURCES], "repo_id string, file_path string, language string, content string")
    return ex.extract_files(files)


@query(f"SELECT path, type, name, CAST(first AS INTEGER) AS line_start, CAST(last AS INTEGER) AS line_end, doc, decorators FROM {_values(golden.rows(golden.NODES), 'path, type, name, first, last, doc, decorators')}")
def extract_golden_nodes(spark, d):
    """Nodes of small sources in all languages, against rows checked by hand."""
    n = ex.extracted_nodes(_golden(spark))
    return n.select(F.col("file_path").alias("path"), "type", "name", "line_start", "line_end", F.coalesce("docstring", F.lit("")).alias("doc"), F.array_join("metadata.decorators", " ").alias("decorators"))


@query(f"SELECT source, relation, target, name, confidence, CAST(line AS INTEGER) AS line FROM {_values(golden.rows(golden.EDGES), 'source, relation, target, name, confidence, line')}")
def extract_golden_edges(spark, d):
    """Raw edges of small sources in all languages, against rows checked by hand."""
    e = ex.extracted_edges(_golden(spark))
    return e.select(F.substring("src", 4, 1 << 20).alias("source"), "relation", F.coalesce(F.substring("tgt", 4, 1 << 20), F.lit("")).alias("target"), F.coalesce("tgt_name", F.lit("")).alias("name"), "confidence", "line")


# -- what clients ask -----------------------------------------------------------------------------------------------------
_REPO = "corekit"
#: The graph of one repository, as the client's questions see it.
_ONE = f"""{NE}, m AS (SELECT * FROM n WHERE repo_id = '{_REPO}'), arcs AS (SELECT source_id AS src, target_id AS dst, relation, confidence, weight, seq FROM
  (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY seq DESC) AS k FROM e WHERE repo_id = '{_REPO}' AND source_id IS NOT NULL AND target_id IS NOT NULL)
  WHERE k = 1 AND source_id IN (SELECT id FROM m) AND target_id IN (SELECT id FROM m))"""


def _api(spark, d):
    c = _code(spark, d)
    return Api(table(spark, d, "repos"), c.nodes, c.edges, None, c.index)


def _answer(spark, rows: list[tuple], columns: str):
    return spark.createDataFrame(rows, columns)


def _hub(spark, d) -> str:
    """The node of the repository that most arcs of it lead to."""
    g = gr.load_graph(_code(spark, d).nodes, _code(spark, d).edges, _REPO)
    row = st.top_by(g.arcs, "dst").first()
    return row[0] if row else "none"


@query("SELECT p.id AS repo_id, p.place, r.n_nodes, r.n_edges FROM (SELECT id, row_number() OVER (ORDER BY last_indexed DESC NULLS LAST, id)::BIGINT AS place FROM repos) p JOIN (" + SQL["repo_stats"] + ") r ON r.repo_id = p.id")
def api_list_repos(spark, d):
    repos = json.loads(_api(spark, d).list_repos())["repos"]
    return _answer(spark, [(r["repo_id"], i + 1, r["n_nodes"], r["n_edges"]) for i, r in enumerate(repos)], "repo_id string, place bigint, n_nodes bigint, n_edges bigint")


@query("SELECT id, row_number() OVER (ORDER BY rank, id) AS place FROM (" + _search_sql("SELECT id, count(*)::DOUBLE AS f FROM words WHERE starts_with(term, 'reg') GROUP BY 1", 20, within=f"WHERE h.id IN (SELECT id FROM n WHERE repo_id = '{_REPO}')") + ")")
def api_query(spark, d):
    """The answer to a search in one repository."""
    found = json.loads(_api(spark, d).query(_REPO, "reg"))["results"]
    return _answer(spark, [(r["id"], i + 1) for i, r in enumerate(found)], "id string, place bigint")


_HUB = "start AS (SELECT dst AS id FROM arcs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _ask(a: str, b: str, depth: int) -> str:
    return f"""WITH RECURSIVE {_ONE}, {_HUB}, walk(id, depth) AS (SELECT t.{b}, 1 FROM start s JOIN arcs t ON t.{a} = s.id UNION SELECT t.{b}, w.depth + 1 FROM walk w JOIN arcs t ON t.{a} = w.id WHERE w.depth < {depth})
    SELECT '{'in' if a == 'dst' else 'out'}' AS direction, id, min(depth)::BIGINT AS depth FROM walk GROUP BY id"""


@query(_ask("dst", "src", 3))
def api_impact(spark, d):
    """The answer to what a change of the busiest node of one repository may break."""
    files = json.loads(_api(spark, d).impact(_REPO, _hub(spark, d), 3))["by_file"]
    return _answer(spark, [("in", r["id"], r["depth"]) for rows in files.values() for r in rows], "direction string, id string, depth bigint")


@query(_ask("src", "dst", 2) + " UNION ALL SELECT * FROM (" + _ask("dst", "src", 2) + ")")
def api_dependencies(spark, d):
    """The answer to what the busiest node of one repository uses, and what uses it."""
    out = json.loads(_api(spark, d).dependencies(_REPO, _hub(spark, d), 2, "both"))
    rows = [(w, r["id"], r["depth"]) for w, k in (("out", "dependencies"), ("in", "dependents")) for r in out[k][k]]
    return _answer(spark, rows, "direction string, id string, depth bigint")


@query()
def overview_cached(spark, d):
    """The overview of every repository as it is kept."""
    columns = ["id", "repo_id", "type", "name", "file_path", "language"]
    nodes = kept(st.latest_nodes(table(spark, d, "nodes").select(*columns, "updated_at")).select(columns), "vertices")
    edges = kept(st.latest_edges(table(spark, d, "edges").select("id", "repo_id", "source_id", "target_id", "relation", "confidence", "seq")).drop("id", "weight"), "edges")
    return ov.overviews(gr.Graph(nodes, gr.collapse(edges)), nodes, edges)


@query()
def report_markdown(spark, d):
    """The report on every repository, a row per line."""
    return ov.reports(kept(overview_cached(spark, d), "overviews"))
