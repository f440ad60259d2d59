"""Joins and choices per group that no hot key can bring to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it holds at least one of so many rows; so there are at most so many hot keys.
HOT = 10_000
#: Parts of a group from which a choice is made first.
PARTS = 64


def hot_keys(rows: DataFrame, key: str, least: int = HOT) -> DataFrame:
    """(key) of the values that hold at least one of ``least`` rows; at most ``least`` of them, by one aggregation that combines map-side."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") * least >= F.col("total")).select(key)


def spread_join(rows: DataFrame, unique: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows with the other columns of ``unique``, which has one row per key (null where it has none; null keys match nothing).

    hot: :func:`hot_keys` of rows, or any set of keys that holds them; it has at most HOT rows, so what
    ``unique`` says of them is broadcast. All other rows are joined by their key; hot ones go where a random
    number leads, as they need no partner there.
    """
    others = [c for c in unique.columns if c != key]
    known = unique.join(F.broadcast(hot), key, "left_semi")
    known = known.select(F.col(key).alias("_hot"), F.struct(*others).alias("_known"))
    rest = unique.select(F.col(key).alias("_key"), F.struct(*others).alias("_found"))
    mine = rows.join(F.broadcast(known), F.col(key) == F.col("_hot"), "left")
    at = F.when(F.col("_hot").isNull(), F.col(key))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))).otherwise(-1)
    mine = mine.withColumns({"_at": at, "_salt": salt})
    joined = mine.join(rest.withColumn("_side", F.lit(-1).cast("bigint")), (F.col("_at") == F.col("_key")) & (F.col("_salt") == F.col("_side")), "left")
    both = F.coalesce("_known", "_found")
    return joined.select(*rows.columns, *(both[c].alias(c) for c in others))


def first_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int, salt: Sequence[str]) -> DataFrame:
    """The first k rows of every group: of parts of it (by a hash of ``salt``) first, then of what the parts gave, so a task sorts a part of a group or PARTS * k rows."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64(*salt), F.lit(PARTS)))
    part = part.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).where(F.col("_place") <= k)
    last = part.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_place") <= k)
    return last.withColumnRenamed("_place", "place").drop("_part")


def first_rows(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows of every group, with their place, by one shuffle: Spark cuts each task's part of a group to k rows before that (for k up to spark.sql.optimizer.windowGroupLimitThreshold, by default 1,000)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)
