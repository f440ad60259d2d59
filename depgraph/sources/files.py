"""Source trees: scanning, exclusion, languages, hashes and what changed since the last ingest."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and file endings that are left out, and the language of each file extension.
DEFAULT_EXCLUDES = ("vendor", "node_modules", "public/js", "public/css", "public/build", "storage", "bootstrap/cache", ".git", ".idea", "__pycache__", "dist", "build", ".next", ".nuxt", "stories", "umd")
EXCLUDED_SUFFIXES = (".min.js", ".min.css", ".bundle.js", ".chunk.js")
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "php": "php", "cs": "csharp",
    "kt": "kotlin", "kts": "kotlin", "scala": "scala", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
}


@dataclass
class RepoConfig:
    """Settings of a repository. languages and include_docs are informative."""

    name: str
    languages: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    include_docs: list[str] = field(default_factory=list)


def load_config(root: str, file_name: str = ".depgraph.yml") -> RepoConfig:
    """The repository's own settings; defaults where the file is missing, malformed or of another shape."""
    config = RepoConfig(os.path.basename(os.path.abspath(root)))
    try:
        import yaml

        with open(os.path.join(root, file_name), encoding="utf-8") as f:
            given = yaml.safe_load(f)
    except Exception:
        return config
    if isinstance(given, dict):
        config.name = str(given.get("name") or config.name)
        for k in ("languages", "exclude", "include_docs"):
            if isinstance(given.get(k), list):
                setattr(config, k, [str(x) for x in given[k]])
    return config


def excluded(path: str, patterns: Sequence[str]) -> Column:
    """Whether a path falls under a pattern: ``**/x/**`` and plain ``x`` match a component, ``a/b`` a run of components."""
    parts, c = F.split(F.col(path), "/"), F.lit(False)
    single, runs = [], []
    for p in (p.strip("/") for p in patterns):
        if "**" in p:
            single.append(p.replace("**/", "").replace("/**", ""))
        elif "/" in p:
            runs.append(p)
        elif p:
            single.append(p)
    if single:
        c = c | F.arrays_overlap(parts, F.array(*map(F.lit, single)))
    for r in runs:
        c = c | F.concat(F.lit("/"), F.col(path), F.lit("/")).contains(f"/{r}/")
    return F.coalesce(c, F.lit(False))


def suffix_excluded(path: str) -> Column:
    c = F.lit(False)
    for s in EXCLUDED_SUFFIXES:
        c = c | F.lower(path).endswith(s)
    return F.coalesce(c, F.lit(False))


def language_of(path: str) -> Column:
    """Language by file extension, in any case; null if it isn't supported."""
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.try_element_at(table, F.lower(F.element_at(F.split(F.col(path), r"\."), -1)))


def scan(spark: SparkSession, root: str, repo_id: str, exclude: Sequence[str] = ()) -> DataFrame:
    """The supported, not excluded files below a folder: repo_id, file_path (relative), language, modification_time, n_bytes, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "file:" + os.path.abspath(root).rstrip("/") + "/"
    path = F.regexp_replace("path", "^file:/+", "file:/")
    rel = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(F.col("path"))
    rows = files.select(F.lit(repo_id).alias("repo_id"), rel.alias("file_path"), F.col("modificationTime").alias("modification_time"), F.col("length").alias("n_bytes"), "content")
    rows = rows.withColumn("language", language_of("file_path")).where("language IS NOT NULL")
    rows = rows.where(~suffix_excluded("file_path") & ~excluded("file_path", [*DEFAULT_EXCLUDES, *exclude]))
    return rows.withColumn("file_hash", F.md5("content")).withColumn("content", F.decode("content", "UTF-8"))


def file_states(now: DataFrame, before: DataFrame) -> DataFrame:
    """(repo_id, file_path, state): new, changed, skipped (same hash) or stale (no longer there). Both sides: repo_id, file_path, file_hash."""
    a = now.select("repo_id", "file_path", F.col("file_hash").alias("new_hash"), F.lit(True).alias("is_now"))
    b = before.select("repo_id", "file_path", F.col("file_hash").alias("old_hash"), F.lit(True).alias("was"))
    both = a.join(b, ["repo_id", "file_path"], "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("is_now").isNull(), "stale").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "skipped").otherwise("changed")
    return both.select("repo_id", "file_path", state.alias("state"))
