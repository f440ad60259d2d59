"""Persistent ordinals: every key gets a small integer that it keeps in later deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets into which keys are hashed at least, and rows for which one more is taken (always a power of two of them);
#: ordinals are unique within a bucket, so no global numbering is needed, and stay so when every bucket is split.
BUCKETS, BUCKET_ROWS = 256, 1_000_000


def buckets_for(n_rows: int, known: DataFrame | None = None) -> int:
    """How many buckets so many rows need; never fewer than a dictionary has."""
    have = known.agg(F.max("bucket")).first()[0] if known is not None and "bucket" in known.columns else None
    n = max(n_rows // BUCKET_ROWS, have or 0, BUCKETS - 1)
    return 1 << n.bit_length()


def bucket(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def with_ordinals(rows: DataFrame, key: str, known: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """rows plus ``bucket`` and ``ordinal``, equal keys alike, whole buckets together; sorted by ordinal without ``known``.

    known: (key, ordinal) of earlier deliveries; those ordinals stay, new keys of a bucket go on behind its
    largest. Rows with a null key share an ordinal of their own; callers filter them if that isn't wanted.
    One shuffle, by bucket, of rows and known keys together; a bucket is never split, and it's streamed, so
    its size is bounded by disk only.
    """
    rows = rows.withColumn("bucket", bucket(key, buckets))
    by = Window.partitionBy("bucket")
    if known is None:
        return rows.withColumn("ordinal", (F.dense_rank().over(by.orderBy(key)) - 1).cast("long"))
    old = known.select(F.col(key), bucket(key, buckets).alias("bucket"), F.col("ordinal").cast("long").alias("known_ordinal"), F.lit(False).alias("given"))
    both = rows.withColumns({"known_ordinal": F.lit(None).cast("long"), "given": F.lit(True)}).unionByName(old, allowMissingColumns=True)
    same = Window.partitionBy("bucket", key)
    both = both.withColumn("known_ordinal", F.max("known_ordinal").over(same)).withColumn("first", F.row_number().over(same.orderBy(key)) == 1)
    fresh = F.sum(F.when(F.col("first") & F.col("known_ordinal").isNull(), 1).otherwise(0)).over(by.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    ordinal = F.coalesce("known_ordinal", F.coalesce(F.max("known_ordinal").over(by), F.lit(-1)) + fresh).cast("long")
    return both.withColumn("ordinal", ordinal).where("given").drop("known_ordinal", "given", "first")


def key_dictionary(rows: DataFrame, key: str, known: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key, bucket, ordinal) of the keys of rows together with all known ones, to be stored for the next delivery."""
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    if known is not None:
        keys = keys.unionByName(known.select(key)).distinct()
    return with_ordinals(keys, key, known, buckets).select(key, "bucket", "ordinal")
