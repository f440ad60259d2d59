"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depgraph.plans import codegraph, training


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return codegraph.impact_d3(spark, folder)


QUERIES = {**codegraph.Q, **training.QUERIES}
SQL = {**codegraph.SQL, **training.SQL}
