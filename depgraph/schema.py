"""Schemas of the stored tables."""

from __future__ import annotations

REPOS = "id string, path string, name string, languages array<string>, last_indexed timestamp, node_count bigint, edge_count bigint, status string"
REPO_METRICS = "repo_id string, metric string, value_json string, computed_at timestamp"
#: Tables of which a version holds whole repositories; they are partitioned by version and repository.
FILES = "file_path string, language string, file_hash string"
NODES = "id string, type string, name string, file_path string, language string, line_start int, line_end int, docstring string, ord struct<file_path: string, ord: bigint>, metadata struct<decorators: array<string>>"
RAW_EDGES = "file_path string, src string, tgt string, tgt_name string, relation string, confidence string, line int, seq struct<file_path: string, n: bigint>"
EDGES = "id string, source_id string, target_id string, relation string, confidence string, source_line int, seq struct<file_path: string, n: bigint>"
POSTINGS = "id string, col string, pos int, term string"
LENGTHS = "id string, n_tokens int"
BY_REPO = {"files": FILES, "nodes": NODES, "raw_edges": RAW_EDGES, "edges": EDGES, "postings": POSTINGS, "lengths": LENGTHS}
MANIFEST = "repo_id string, v string"
