"""Problem 3: what changed between full snapshots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.operators.bitmaps import CHUNK, Bitmap
from depgraph.operators.ordinals import buckets_for, key_dictionary, with_ordinals

KINDS = ("added", "removed", "changed")


#: Rows held before complete blocks of ordinals are compared (a block is at most 65,536 ordinals and always whole).
HELD_ROWS = 200_000


def _diff_blocks(nos: Sequence[int], at: np.ndarray, snap: np.ndarray, values: np.ndarray, keys: pa.Array):
    """Changes in whole blocks. at: position of each row, which is its block's number and its ordinal in the block."""
    ordinals, where = np.unique(at, return_inverse=True)
    row_of = np.empty(len(ordinals), np.int64)
    row_of[where] = np.arange(len(at))  # a row that has the key
    bitmaps, vectors = [], []
    for k in range(len(nos)):
        mine = snap == k
        bitmaps.append(Bitmap(at[mine]))
        v = np.zeros((len(ordinals), values.shape[1]), np.int64)  # aligned by ordinal
        v[where[mine]] = values[mine]
        vectors.append(v)
    for k in range(1, len(nos)):
        both = np.searchsorted(ordinals, (bitmaps[k] & bitmaps[k - 1]).to_array())
        changed = ordinals[both[(vectors[k][both] != vectors[k - 1][both]).any(axis=1)]]
        for kind, which in zip(KINDS, (bitmaps[k].and_not(bitmaps[k - 1]).to_array(), bitmaps[k - 1].and_not(bitmaps[k]).to_array(), changed)):
            if len(which):
                yield nos[k], keys.take(pa.array(row_of[np.searchsorted(ordinals, which)])), kind


def _diff(n_nos: int, n_values: int, names: Sequence[str]):
    nos = range(n_nos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last, number = 0, None, 0

        def flush(held):
            at, snap, values = (np.concatenate([h[i] for h in held]) for i in range(3))
            for no, key, kind in _diff_blocks(nos, at, snap, values, pa.concat_arrays([h[3] for h in held])):
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(key), pa.int32()), key, pa.array([kind] * len(key))], list(names))

        for b in batches:
            if not b.num_rows:
                continue
            ordinal = b.column(1).to_numpy()
            block = b.column(0).to_numpy().astype(np.int64) << 40 | ordinal >> 16
            snap = b.column(3).to_numpy()
            values = np.stack([b.column(4 + i).to_numpy() for i in range(n_values)], axis=1)
            new = np.empty(len(block), np.bool_)
            new[0], new[1:] = block[0] != last, block[1:] != block[:-1]
            seq = number + np.cumsum(new)
            number, last = int(seq[-1]), block[-1]
            cut = int(np.flatnonzero(new)[-1]) if size + len(block) > HELD_ROWS and new.any() else 0
            at = seq << 16 | ordinal & (CHUNK - 1)
            if cut or size > HELD_ROWS and new[0]:
                if cut:
                    held.append((at[:cut], snap[:cut], values[:cut], b.column(2).slice(0, cut)))
                yield from flush(held)
                held, size = [], 0
            held.append((at[cut:], snap[cut:], values[cut:], b.column(2).slice(cut)))
            size += len(block) - cut
        if held:
            yield from flush(held)

    return run


def fingerprint(c: str, kind: str, fold: bool):
    """A 64-bit value that is equal for equal values; null has one of its own. Numbers and dates map to themselves."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(c).cast("bigint"), F.lit(-(1 << 63)))
    return F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.xxhash64(F.lower(c) if fold else F.col(c)))


def snapshot_changes(snapshots: DataFrame, columns: Sequence[str], key: str = "id", no: str = "snapshot_no", loaded: str = "loaded_at", fold: Sequence[str] = (), known: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Keys added, removed or changed between consecutive snapshots: (no, key, change_kind).

    Within a snapshot the row of a key with the latest ``loaded`` counts (null is earliest; on a tie, the row
    with the largest fingerprints); rows with a null key or number don't count. A change is a difference in
    one of ``columns``; null equals null, case is ignored in those of ``fold``. Consecutive are the numbers
    that occur, so a number that was never delivered is passed over. Empty tables and a single snapshot give
    no rows; other columns are ignored.

    The number may be of any type that has an order. Repeated deliveries are merged before the shuffle. Keys get persistent ordinals (``known`` from
    :func:`~depgraph.operators.ordinals.key_dictionary` keeps those of earlier runs); each block of 65,536
    ordinals has one compressed bitmap per snapshot, whose AND-NOT gives additions and removals, and
    vectors of column fingerprints aligned by ordinal, compared where both bitmaps have a bit. Strings are
    compared by a 64-bit hash. Only some blocks at a time are in memory.
    """
    kinds = dict(snapshots.dtypes)
    rows = snapshots.where(F.col(key).isNotNull() & F.col(no).isNotNull())
    per_no = rows.groupBy(no).agg(F.count("*").alias("n")).orderBy(no).collect()  # a row per delivery
    if not per_no:
        return rows.select(no, key, F.lit("").alias("change_kind")).where("false")
    buckets = buckets or buckets_for(sum(r["n"] for r in per_no), known)
    nos = F.array(*(F.lit(r[0]).cast(kinds[no]) for r in per_no))
    values = [fingerprint(c, kinds[c], c in fold).alias(f"v{i}") for i, c in enumerate(columns)]
    rows = rows.select(F.col(key), (F.array_position(nos, F.col(no)) - 1).cast("int").alias("delivery"), F.col(loaded).alias("loaded"), *values)
    last = F.max(F.struct("loaded", *(f"v{i}" for i in range(len(columns)))))
    rows = rows.groupBy("delivery", key).agg(last.alias("r")).select(key, "delivery", *(f"r.v{i}" for i in range(len(columns))))
    rows = with_ordinals(rows, key, known, buckets)
    if known is not None:
        rows = rows.sortWithinPartitions("bucket", "ordinal")
    rows = rows.select("bucket", "ordinal", key, "delivery", *(f"v{i}" for i in range(len(columns))))
    found = rows.mapInArrow(_diff(len(per_no), len(columns), ["delivery", key, "change_kind"]), f"delivery int, `{key}` {kinds[key]}, change_kind string")
    return found.select(F.element_at(nos, F.col("delivery") + 1).alias(no), key, "change_kind")


def earlier_keys(snapshots: DataFrame, key: str = "id", no: str = "snapshot_no") -> DataFrame:
    """The key dictionary as it stands when the last snapshot arrives: of the keys of all snapshots before it."""
    rows = snapshots.where(F.col(key).isNotNull() & F.col(no).isNotNull())
    n, last = rows.agg(F.count("*"), F.max(no)).first()
    before = rows.where(F.col(no) < F.lit(last)) if n else rows
    return key_dictionary(before, key, None, buckets_for(n))


NODE_COLUMNS = ("repo_id", "type", "name", "file_path", "language", "line_start", "line_end", "file_hash")


def node_changes(snapshots: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """:func:`snapshot_changes` of node_snapshots; letter case carries no meaning in file_hash."""
    return snapshot_changes(snapshots, NODE_COLUMNS, fold=("file_hash",), known=known)
