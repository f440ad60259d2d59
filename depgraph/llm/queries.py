"""Queries of the text problems (1, 2, 5 to 8), with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.llm import functions as fn
from depgraph.llm import harm, mixing, origin, syntax, tokens
from depgraph.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_syntax(table(spark, d, "source_files")).where("NOT valid").select("file_id")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of invalid files per repository and language."""
    return syntax.invalid_rates(syntax.check_syntax(table(spark, d, "source_files")), "repo_id", "language")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return fn.document_nodes(table(spark, d, "nodes"), table(spark, d, "source_files")).select("id")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description of every documented function."""
    return fn.document_nodes(table(spark, d, "nodes"), table(spark, d, "source_files")).select("id", "language", "description", "n_words", "valid", "code")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.not_handwritten(table(spark, d, "source_files"), table(spark, d, "repos")).select("file_id")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why files aren't hand-written: number of files per reason (a file may have several)."""
    found = origin.not_handwritten(table(spark, d, "source_files"), table(spark, d, "repos"))
    return found.select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Copies of every document in the mix."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).select("doc_id", "source", "n_tokens", "copies")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares wanted and reached."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return harm.score_documents(table(spark, d, "documents"), table(spark, d, "doc_labels")).where("harmful").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document."""
    return harm.score_documents(table(spark, d, "documents"), table(spark, d, "doc_labels")).select("doc_id", "score", "harmful")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of harmful documents per source."""
    return harm.rates(harm.score_documents(table(spark, d, "documents"), table(spark, d, "doc_labels")))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_pairs, p5_found, p5_reasons, p6_ids, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)}
SQL: dict[str, str] = {}
