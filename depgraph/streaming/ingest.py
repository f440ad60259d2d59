"""Streams that keep a store current: files as they arrive, and push events."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depgraph.operators.ingest import Store, ingest
from depgraph.sources.files import DEFAULT_EXCLUDES, excluded, language_of, suffix_excluded

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
EVENT_SCHEMA = "repository string, ref string, pushed_at timestamp"
#: As a web hook delivers them: the kind of event, the signature of the payload, and the payload as text.
SIGNED_SCHEMA = "event string, signature string, payload string"
PAYLOAD_SCHEMA = "repository struct<name: string>, ref string, pushed_at timestamp"


def _latest_files(batch: DataFrame, root: str, repo_id: str) -> DataFrame:
    """The newest state of each path in a batch (files may arrive twice or out of order)."""
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    rows = batch.select(F.lit(repo_id).alias("repo_id"), rel.alias("file_path"), "modificationTime", F.md5("content").alias("file_hash"), F.decode("content", "UTF-8").alias("content")).withColumn("language", language_of("file_path"))
    rows = rows.where("language IS NOT NULL").where(~suffix_excluded("file_path") & ~excluded("file_path", DEFAULT_EXCLUDES))
    place = F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy(F.desc("modificationTime"), "file_hash"))
    return rows.withColumn("place", place).where("place = 1").drop("place", "modificationTime")


def stream_files(spark: SparkSession, root: str, repo_id: str, store_folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Ingest files as they appear below a folder. Replayed batches change nothing: an ingest depends on the files alone."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(root)

    def each(batch: DataFrame, _: int) -> None:
        rows = _latest_files(batch, root, repo_id)
        if not rows.isEmpty():
            ingest(Store(batch.sparkSession, store_folder), rows, complete=False)

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def signature(payload: str, secret: str) -> Column:
    """Keyed SHA-256 (HMAC) of a text column as a web hook states it: ``sha256=`` and 64 hexadecimal digits."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(payload, "UTF-8")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(pad(0x5C), inner), 256))


def verified_pushes(signed: DataFrame, secret: str) -> DataFrame:
    """(repository, ref, pushed_at) of the push events whose signature fits their payload; all other events are left out, so are payloads that are no JSON."""
    good = signed.where((F.col("event") == "push") & (F.lower("signature") == signature("payload", secret)))
    parsed = good.select(F.from_json("payload", PAYLOAD_SCHEMA).alias("p"))
    return parsed.select("p.repository.name", "p.ref", "p.pushed_at").withColumnRenamed("name", "repository").where("repository IS NOT NULL")


def pushed_repos(events: DataFrame, repos: DataFrame) -> DataFrame:
    """Repositories (id, path) that push events speak of, by name or id; each once, a name that fits several goes to the least id."""
    by_id = events.join(repos.select(F.col("id").alias("repository"), "id", "path"), "repository")
    by_name = events.join(repos.select(F.col("name").alias("repository"), "id", "path"), "repository").join(by_id.select("repository").distinct(), "repository", "left_anti")
    return by_id.unionByName(by_name).groupBy("repository").agg(F.min(F.struct("id", "path")).alias("r")).select("r.id", "r.path").distinct()


def stream_pushes(spark: SparkSession, events_folder: str, repos: DataFrame, scan, store_folder: str, checkpoint: str, secret: str | None = None) -> StreamingQuery:
    """Ingest the repositories named by push events (JSON files). scan(id, path) gives a repository's files.

    With a secret, events come as a web hook delivers them, and only push events with the right signature count.
    """
    events = spark.readStream.schema(SIGNED_SCHEMA).json(events_folder) if secret else spark.readStream.schema(EVENT_SCHEMA).json(events_folder)
    events = verified_pushes(events, secret) if secret else events

    def each(batch: DataFrame, _: int) -> None:
        for r in pushed_repos(batch.select("repository").distinct(), repos).collect():  # a row per pushed repository
            ingest(Store(batch.sparkSession, store_folder), scan(r["id"], r["path"]))

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
