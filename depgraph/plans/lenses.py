"""Small dense graphs derived from the trade tables, for operators that need cycles and many paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depgraph.functions.exprs import weight
from depgraph.operators.graph import Graph
from depgraph.sources.tables import table


def trade(spark: SparkSession, d: str) -> Graph:
    """Nations; an arc goes from each to the three that buy most lines from its suppliers (calls, imports, uses)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = lines.where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("n"), "c_nationkey"))
    best = pairs.withColumn("place", place).where("place <= 3")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("place"))
    name = lambda c: F.concat(F.lit("nation:"), F.col(c))
    arcs = best.select(name("s_nationkey").alias("src"), name("c_nationkey").alias("dst"), pick("calls", "imports", "uses").alias("relation"), pick("EXTRACTED", "INFERRED", "AMBIGUOUS").alias("confidence"), F.col("place").cast("bigint").alias("seq"))
    vertices = table(spark, d, "nation").select(name("n_nationkey").alias("id"), F.lit("trade").alias("repo_id"), F.lit("class").alias("type"), F.col("n_name").alias("name"), F.lit("nation").alias("file_path"), F.lit("none").alias("language"))
    return Graph(vertices, arcs.withColumn("weight", weight()).select("src", "dst", "relation", "confidence", "weight", "seq"))


#: Stretches of time into which rows are split to find what follows each.
STRETCHES = 10_000


def following(rows: DataFrame, time: str, order: str, value: str) -> DataFrame:
    """rows plus ``next``: the value of the row that follows by time and order.

    Time is split into at most STRETCHES stretches, each sorted by itself; the last row of one looks at the
    first row of the next that has any, of which there are at most STRETCHES.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = max(1, ((high or 0) - (low or 0)) // (STRETCHES - 1) + 1)
    cut = rows.withColumn("stretch", F.coalesce(F.floor((at - F.lit(low or 0)) / F.lit(width)), F.lit(-1)))
    here = cut.withColumn("next", F.lead(F.struct(value)).over(Window.partitionBy("stretch").orderBy(time, order)))
    firsts = cut.groupBy("stretch").agg(F.min_by(F.struct(value), F.struct(time, order)).alias("first"))
    behind = firsts.select("stretch", F.lead("first").over(Window.orderBy("stretch")).alias("behind"))
    both = here.join(F.broadcast(behind), "stretch")
    return both.withColumn("next", F.coalesce("next", "behind")[value]).drop("stretch", "behind")


def handoff(spark: SparkSession, d: str) -> Graph:
    """Users; an arc goes from the user of an error to the user of the next event."""
    events = table(spark, d, "events")
    pairs = following(events, "ts", "event_id", "user_id").where("event_type = 'error' AND next IS NOT NULL AND next <> user_id")
    name = lambda c: F.concat(F.lit("user:"), F.col(c))
    arcs = pairs.groupBy(name("user_id").alias("src"), name("next").alias("dst")).agg(F.max("event_id").alias("seq"))
    vertices = events.select(name("user_id").alias("id")).distinct().select("id", F.lit("handoff").alias("repo_id"), F.lit("class").alias("type"), F.col("id").alias("name"), F.lit("events").alias("file_path"), F.lit("none").alias("language"))
    return Graph(vertices, arcs.select("src", "dst", F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"), "seq"))


def catalog_edges(spark: SparkSession, d: str) -> DataFrame:
    """Containment of regions, nations, suppliers and customers, as edges."""
    nation = table(spark, d, "nation")
    name = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c))
    one = lambda r, a, b: r.select(a.alias("src"), b.alias("dst"))
    e = one(nation, name("region", "n_regionkey"), name("nation", "n_nationkey"))
    e = e.unionByName(one(table(spark, d, "supplier"), name("nation", "s_nationkey"), name("supplier", "s_suppkey")))
    return e.unionByName(one(table(spark, d, "customer"), name("nation", "c_nationkey"), name("customer", "c_custkey")))


TRADE_SQL = """
trade_pairs AS (SELECT s_nationkey, c_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
trade_best AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, c_nationkey) AS place FROM trade_pairs QUALIFY place <= 3),
trade AS (SELECT 'nation:' || s_nationkey AS src, 'nation:' || c_nationkey AS dst, ['calls', 'imports', 'uses'][place] AS relation, [14, 20, 35][place] AS cost, [10, 7, 4][place] AS dist FROM trade_best)
"""
HANDOFF_SQL = """
following AS (SELECT event_type, user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS next FROM events),
handoff AS (SELECT DISTINCT 'user:' || user_id AS src, 'user:' || next AS dst FROM following WHERE event_type = 'error' AND next IS NOT NULL AND next <> user_id),
handoff_nodes AS (SELECT DISTINCT 'user:' || user_id AS id FROM events)
"""
