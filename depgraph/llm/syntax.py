"""Problem 1: source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgraph.llm import lexers


def is_valid(text: str, language: str | None, path: str | None = None) -> bool | None:
    """Whether a dialect of the language accepts the whole text; None without text or with an unknown language."""
    dialects = lexers.of(language, path) if text is not None else []
    return any(d.valid(text) for d in dialects) if dialects else None


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("content", "language", "file_path"))
        valid = pa.array([is_valid(*x) for x in zip(*cols)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(i) for i in (0, 1, 2, 3)] + [valid], ["file_id", "repo_id", "language", "modification_time", "valid"])


def check_syntax(files: DataFrame) -> DataFrame:
    """One row per file_id: file_id, repo_id, language (lower case), valid.

    Every dialect grammar of the row's language runs over the whole content (see :mod:`depgraph.llm.gll`);
    valid is false if all of them reject it. Empty tables give no rows; null content or an unsupported or
    null language gives a null verdict; rows without file_id are left out. Of repeated rows the one with the
    latest modification_time counts (null is earliest; a readable one before an unreadable one). Other
    columns of the input are ignored. Texts never leave the executor that read them: only the verdicts are
    shuffled.
    """
    given = files.select("file_id", "repo_id", F.lower("language").alias("language"), "modification_time", "content", "file_path").where("file_id IS NOT NULL")
    kinds = dict(given.dtypes)
    schema = f"file_id {kinds['file_id']}, repo_id string, language string, modification_time {kinds['modification_time']}, valid boolean"
    verdicts = given.mapInArrow(_verdicts, schema)
    last = F.max(F.struct(F.col("valid").isNotNull().alias("read"), "modification_time", "valid", "repo_id", "language"))
    return verdicts.groupBy("file_id").agg(last.alias("r")).select("file_id", "r.repo_id", "r.language", "r.valid")


def invalid_rates(verdicts: DataFrame, *by: str) -> DataFrame:
    """Files, unreadable files, invalid files and their rate among the readable ones, per group."""
    count = lambda c: F.count_if(c)
    bad: Column = count(~F.col("valid"))
    read = count(F.col("valid").isNotNull())
    return verdicts.groupBy(*by).agg(F.count("*").alias("n_files"), (F.count("*") - read).alias("n_unread"), bad.alias("n_invalid"), F.try_divide(bad, read).alias("invalid_rate"))
