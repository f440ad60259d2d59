"""Intermediate results that outlive an executor: written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in tests, where it's unset and all runs in one process, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="depgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to a folder of its own, which goes when the session's driver ends, and read again."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder), folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut and no executor's loss costs it."""
    return _written(df, name)[0]


def checkpointed(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read again, for results that loops replace step by step.

    A checkpoint of Spark's own hands the estimated size of a result on to the next step, where joins multiply
    it, until planning takes longer than running; files have their real size. ``replaces``, an earlier result of
    this function that nothing needs any more, is deleted.
    """
    out, out_folder = _written(df, "step")
    out._step_folder = out_folder
    if replaces is not None:
        drop(df.sparkSession, getattr(replaces, "_step_folder", None))
    return out


def drop(spark: SparkSession, folder: str | None) -> None:
    """Delete a folder that this module wrote."""
    if folder and folder.startswith(shared_folder(spark)):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
