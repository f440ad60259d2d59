"""Ranked full-text search over nodes: postings, phrases and prefixes, BM25."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.functions.exprs import search_tokens

#: Fixed values of the ranking.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("name", "docstring", "file_path")


@dataclass
class Index:
    """postings: (id, col, pos, term), one row per word; lengths: (id, n_tokens) of every indexed row, also of empty ones."""

    postings: DataFrame
    lengths: DataFrame


def build_index(rows: DataFrame, key: str = "id", columns: tuple[str, ...] = COLUMNS) -> Index:
    """An index over text columns; nulls are empty texts. key must be unique."""
    words = rows.select(F.col(key).alias("id"), *(search_tokens(F.col(c)).alias(c) for c in columns))
    each = words.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("words")) for c in columns))).alias("x"))
    postings = each.select("id", "x.col", F.posexplode("x.words").alias("pos", "term"))
    n = sum((F.size(c) for c in columns), F.lit(0))
    return Index(postings, words.select("id", n.alias("n_tokens")))


def query_words(query: str) -> tuple[list[str], bool]:
    """Words of a query, and whether the last one is a prefix: it is unless the query holds a blank. Quotes separate like other signs."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", query.lower()) if unicodedata.category(c) != "Mn")
    words = [w for w in re.split(r"[^\w]|_", plain) if w]
    return words, " " not in query.strip()


def matches(index: Index, query: str) -> DataFrame:
    """(id, hits): how often the words of the query follow each other within one column."""
    words, prefix = query_words(query)
    p = index.postings
    if not words:
        return p.where("false").select("id", F.lit(0).cast("bigint").alias("hits"))
    fits = lambda i: F.col("term").startswith(words[i]) if prefix and i == len(words) - 1 else F.col("term") == words[i]
    if len(words) == 1:
        return p.where(fits(0)).groupBy("id").agg(F.count("*").alias("hits"))
    # every word votes for the position at which its phrase would begin
    votes = None
    for i in range(len(words)):
        one = p.where(fits(i)).select("id", "col", (F.col("pos") - i).alias("at"), F.lit(i).alias("i"))
        votes = one if votes is None else votes.unionByName(one)
    whole = votes.groupBy("id", "col", "at").agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(words))
    return whole.groupBy("id").agg(F.count("*").alias("hits"))


def ranked(index: Index, query: str) -> DataFrame:
    """(id, rank) of the matching rows, best (least) first by rank and id. Statistics are those of the whole index."""
    hits = matches(index, query)
    stats = index.lengths.agg(F.count("*").alias("total"), F.avg("n_tokens").alias("mean"))
    found = hits.agg(F.count("hits").alias("found"))  # of the same columns, so that its shuffle is used twice
    idf = F.log((F.col("total") - F.col("found") + 0.5) / (F.col("found") + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    f = F.col("hits").cast("double")
    score = -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    return hits.join(index.lengths, "id").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(found)).select("id", score.alias("rank"))  # one row each


def search(index: Index, nodes: DataFrame, query: str, limit: int = 20, node_type: str | None = None, repo: str | None = None) -> DataFrame:
    """The best ``limit`` nodes; a type is filtered among the best 3 * limit (after the repository, before the limit)."""
    r = ranked(index, query).join(nodes.select("id", "repo_id", "type", "name", "file_path"), "id")
    if repo is not None:
        r = r.where(F.col("repo_id") == repo)
    r = r.orderBy("rank", "id").limit(3 * limit)
    if node_type is not None:
        r = r.where(F.col("type") == node_type)
    return r.orderBy("rank", "id").limit(limit)


def resolve_node(index: Index, nodes: DataFrame, repo: str, name: str) -> DataFrame:
    """The node with this id in the repository, else the best match of a search for it; no row if there is none."""
    exact = nodes.where((F.col("id") == name) & (F.col("repo_id") == repo)).select("id", F.lit(0).alias("place"))
    near = search(index, nodes, name, 5, None, repo).orderBy("rank", "id").limit(1).select("id", F.lit(1).alias("place"))
    return exact.unionByName(near).orderBy("place").limit(1).select("id")
