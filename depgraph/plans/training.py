"""Queries of the general training-data problems (3 and 4), with the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.operators.heavy import distinct_edges, heavy_keys, key_counts, per_key
from depgraph.operators.snapshots import NODE_COLUMNS, earlier_keys, node_changes
from depgraph.sources.shared import kept
from depgraph.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes, with the ordinals that the keys got in the deliveries before the last, stored and read again."""
    snapshots = table(spark, d, "node_snapshots")
    known = kept(earlier_keys(snapshots), "node-ordinals")
    return node_changes(snapshots, known).select("snapshot_no", "id", "change_kind")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes per snapshot and kind."""
    return p3_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "edges")).select("key_column", "key_value")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges per value of each key column."""
    columns = ["repo_id", "source_id", "target_id"]
    return key_counts(distinct_edges(table(spark, d, "edges"), columns), columns).where("key_column IS NOT NULL")


def _neighbours(spark, d, key, value):
    r = per_key(table(spark, d, "edges"), key, value, 3)
    return r.select("key", "n_rows", "n_values", F.get("top", F.lit(0))["value"].alias("top_value"), F.get("top", F.lit(0))["n"].alias("top_n"))


def p4_in_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Per target: edges, distinct callers and the most frequent caller."""
    return _neighbours(spark, d, "target_id", "source_id")


def p4_out_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Per source: edges, distinct targets and the most frequent target."""
    return _neighbours(spark, d, "source_id", "target_id")


def p4_repo_targets(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: edges, distinct targets and the most frequent target."""
    return _neighbours(spark, d, "repo_id", "target_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p4_found, p4_counts, p4_in_degrees, p4_out_degrees, p4_repo_targets)}

_LATEST = f"""
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM node_snapshots WHERE id IS NOT NULL AND snapshot_no IS NOT NULL) WHERE rn = 1),
nos AS (SELECT snapshot_no AS no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT snapshot_no FROM latest)),
cur AS (SELECT n.no, n.prev, l.* FROM nos n JOIN latest l ON l.snapshot_no = n.no WHERE n.prev IS NOT NULL),
old AS (SELECT n.no, l.* FROM nos n JOIN latest l ON l.snapshot_no = n.prev),
changes AS (SELECT CAST(coalesce(c.no, o.no) AS INTEGER) AS snapshot_no, coalesce(c.id, o.id) AS id,
  CASE WHEN o.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM cur c FULL OUTER JOIN old o ON c.no = o.no AND c.id = o.id
  WHERE o.id IS NULL OR c.id IS NULL OR {" OR ".join(f"c.{x} IS DISTINCT FROM o.{x}" if x != "file_hash" else "lower(c.file_hash) IS DISTINCT FROM lower(o.file_hash)" for x in NODE_COLUMNS)})
"""
_EDGES = "e AS (SELECT id, min(repo_id) AS repo_id, min(source_id) AS source_id, min(target_id) AS target_id FROM edges WHERE id IS NOT NULL GROUP BY id)"
_KEYS = f"{_EDGES}, keys AS (SELECT key_column, key_value, count(*) AS n FROM (SELECT 'repo_id' AS key_column, repo_id AS key_value FROM e UNION ALL SELECT 'source_id', source_id FROM e UNION ALL SELECT 'target_id', target_id FROM e) WHERE key_value IS NOT NULL GROUP BY ALL)"


def _degrees(key, value):
    return f"""WITH {_EDGES}, pairs AS (SELECT {key} AS key, {value} AS value, count(*) AS n FROM e WHERE {key} IS NOT NULL AND {value} IS NOT NULL GROUP BY ALL)
    SELECT key, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_values, arg_min(value, (-n, value)) AS top_value, max(n) AS top_n FROM pairs GROUP BY key"""


SQL = {
    "p3_found": f"WITH {_LATEST} SELECT * FROM changes",
    "p3_counts": f"WITH {_LATEST} SELECT snapshot_no, change_kind, count(*) AS n FROM changes GROUP BY ALL",
    "p4_found": f"WITH {_KEYS} SELECT key_column, key_value FROM keys WHERE n * 50 >= (SELECT count(*) FROM e)",
    "p4_counts": f"WITH {_KEYS} SELECT * FROM keys",
    "p4_in_degrees": _degrees("target_id", "source_id"),
    "p4_out_degrees": _degrees("source_id", "target_id"),
    "p4_repo_targets": _degrees("repo_id", "target_id"),
}
