"""Problem 4: per-key results where a few keys hold most rows.

Rows never travel by key. Each input split dictionary-encodes its keys and adds up dense arrays with
``numpy.bincount``; what is shuffled by key is one number per key and split. So a key with a third of all
rows costs the task that ends with it no more than any other key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys that a split holds before it hands on its arrays and starts anew (bounds its memory, not the result).
FLUSH_KEYS = 500_000


def distinct_edges(edges: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """One row per edge id with the given columns; of differing repeats the least non-null values. Null ids don't count."""
    return edges.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(c).alias(c) for c in columns))


def _partial_counts(columns: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [{} for _ in columns]  # key -> position in the dense array
        dense = [np.zeros(1024, np.int64) for _ in columns]
        total = 0

        def flush():
            for i, name in enumerate(columns):
                if codes[i]:
                    n = len(codes[i])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(list(codes[i]), pa.string()), pa.array(dense[i][:n])], ["key_column", "key_value", "n"])
                    codes[i], dense[i] = {}, np.zeros(1024, np.int64)

        for b in batches:
            total += b.num_rows
            for i in range(len(columns)):
                enc = b.column(i).drop_null().dictionary_encode()
                local = codes[i]
                to = np.fromiter((local.setdefault(v, len(local)) for v in enc.dictionary.to_pylist()), np.int64, len(enc.dictionary))
                if len(local) > len(dense[i]):
                    dense[i] = np.concatenate([dense[i], np.zeros(max(len(dense[i]), len(local) - len(dense[i])), np.int64)])
                dense[i][to] += np.bincount(enc.indices.to_numpy(), minlength=len(to))
            if max(map(len, codes)) > FLUSH_KEYS:
                yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([total], pa.int64())], ["key_column", "key_value", "n"])

    return run


def _sum_blocks(top: int | None):
    """Adds the splits' arrays: rows come sorted by key, so the key's position is its code. top: only so many keys a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key_column", "key_value", "n"]
        best: dict = {}
        carry = None

        def give(rows):
            if top is None:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names)
                return
            for r in rows:
                best.setdefault(r[0], []).append(r)
            for c, rs in best.items():
                if len(rs) > 4 * top:
                    best[c] = sorted(rs, key=lambda r: -r[2])[:top]

        for b in batches:
            if not b.num_rows:
                continue
            c, k, n = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
            new = np.fromiter((i == 0 or c[i] != c[i - 1] or k[i] != k[i - 1] for i in range(len(c))), np.bool_, len(c))
            code = np.cumsum(new) - 1
            sums = np.bincount(code, weights=n).astype(np.int64)
            first = np.flatnonzero(new)
            rows = [(c[i], k[i], s) for i, s in zip(first.tolist(), sums.tolist())]
            if carry is not None and carry[:2] == rows[0][:2]:
                rows[0] = (*carry[:2], carry[2] + rows[0][2])
            elif carry is not None:
                rows.insert(0, carry)
            carry = rows.pop()
            if rows:
                yield from give(rows)
        if carry is not None:
            yield from give([carry])
        for c, rs in best.items():
            rs = sorted(rs, key=lambda r: -r[2])[:top]
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(rs), pa.string()), pa.array([r[1] for r in rs], pa.string()), pa.array([r[2] for r in rs], pa.int64())], names)

    return run


def key_counts(rows: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """How often each non-null value of each column occurs: (key_column, key_value, n), and once (null, null, number of rows).

    The columns must be strings. With ``top``, each partition gives only its ``top`` most frequent keys of a
    column, enough to find every key that holds a share of 1 / top. An empty table gives no keys.
    """
    schema = "key_column string, key_value string, n bigint"
    parts = rows.select(*columns).mapInArrow(_partial_counts(columns), schema)
    parts = parts.repartition(F.xxhash64("key_column", "key_value")).sortWithinPartitions("key_column", "key_value")
    return parts.mapInArrow(_sum_blocks(top), schema)


def heavy_keys(edges: DataFrame, columns: Sequence[str] = ("repo_id", "source_id", "target_id"), share: int = 50) -> DataFrame:
    """(key_column, key_value, n, total) of the values that hold at least 1 / share of all distinct edge ids.

    At most ``share`` values of a column can; each partition offers that many, and the last step sees only
    those. An empty table gives no rows; null values are no keys, but their edges count in the total.
    """
    counts = key_counts(distinct_edges(edges, columns), columns, top=share)
    whole = Window.partitionBy(F.lit(1))  # over share x columns x partitions rows at most
    total = F.sum(F.when(F.col("key_column").isNull(), F.col("n"))).over(whole)
    return counts.withColumn("total", total).where(F.col("key_column").isNotNull() & (F.col("n") * share >= F.col("total")))


def _per_key(k: int):
    """Over (key, value, n) with each pair in one row: per key the sum, the number of values and the k most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        held: list[tuple[np.ndarray, list, np.ndarray]] = []
        size = 0

        def flush():
            nonlocal size
            if not held:
                return
            code, n = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
            value = np.array([v for h in held for v in h[1]], object)
            sums = np.bincount(code, weights=n, minlength=len(codes)).astype(np.int64)
            many = np.bincount(code, minlength=len(codes))
            order = np.lexsort((value.astype(str), -n, code))
            start = np.concatenate([[0], np.cumsum(many)])[:-1]
            rank = np.arange(len(order)) - start[code[order]]
            best = order[rank < k]
            tops: list[list] = [[] for _ in codes]
            for i in best.tolist():
                tops[code[i]].append({"n": -int(n[i]), "value": value[i]})
            kind = pa.list_(pa.struct([("n", pa.int64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()), pa.array(sums), pa.array(many.astype(np.int64)), pa.array(tops, kind)], ["key", "n_rows", "n_values", "top"])
            codes.clear()
            held.clear()
            size = 0

        for b in batches:
            enc = b.column(0).dictionary_encode()
            to = np.fromiter((codes.setdefault(v, len(codes)) for v in enc.dictionary.to_pylist()), np.int64, len(enc.dictionary))
            held.append((to[enc.indices.to_numpy()], b.column(1).to_pylist(), b.column(2).to_numpy()))
            size += b.num_rows
            if size > FLUSH_KEYS:
                yield from flush()
        yield from flush()

    return run


def per_key(edges: DataFrame, key: str, value: str, k: int = 3) -> DataFrame:
    """Per value of ``key``: n_rows, n_values (distinct non-null values of ``value``) and top (its k most frequent values, ``[{n, value}]``).

    Each edge id counts once; a null key has no row, rows with a null value count in none of the results.
    Ties in top go to the smaller value. Pairs of (key, value) are spread over the tasks by their hash, each
    task reduces its pairs per key by scatter-reduce, and only k + 1 numbers per key and task meet at the end.
    """
    rows = distinct_edges(edges, [key, value]).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    pairs = rows.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    parts = pairs.mapInArrow(_per_key(k), "key string, n_rows bigint, n_values bigint, top array<struct<n:bigint,value:string>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
    top = F.transform(best, lambda x: F.struct((-x["n"]).alias("n"), x["value"].alias("value")))
    return parts.groupBy("key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), top.alias("top"))
