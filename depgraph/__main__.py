"""Command line: python -m depgraph index PATH --store FOLDER, and questions to a store."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from depgraph.api import Api
from depgraph.operators.ingest import Store


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="depgraph", description="Dependency graphs of source code.")
    p.add_argument("--store", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="index a repository")
    index.add_argument("path")
    index.add_argument("--force", action="store_true", help="parse every file, changed or not")
    sub.add_parser("repos", help="list the repositories")
    for name, more in (("search", ["query"]), ("dependencies", ["node"]), ("impact", ["node"]), ("path", ["source", "target"]), ("overview", []), ("report", [])):
        q = sub.add_parser(name)
        for a in ("repo", *more):
            q.add_argument(a)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("depgraph").getOrCreate()
    store = Store(spark, a.store)
    if a.command == "index":
        out = Api.build(None, store, a.path, a.force)
    else:
        api = Api.of(store)
        out = {
            "repos": lambda: api.list_repos(), "search": lambda: api.query(a.repo, a.query), "dependencies": lambda: api.dependencies(a.repo, a.node), "impact": lambda: api.impact(a.repo, a.node),
            "path": lambda: api.path(a.repo, a.source, a.target), "overview": lambda: api.overview(a.repo), "report": lambda: api.sync_kb(a.repo),
        }[a.command]()
    print(out)
    return int("error" in json.loads(out))


if __name__ == "__main__":
    sys.exit(main())
