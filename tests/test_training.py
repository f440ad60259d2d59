"""Problems 3 and 4 against plain Python."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from depgraph.operators.bitmaps import Bitmap
from depgraph.operators.heavy import distinct_edges, heavy_keys, key_counts, per_key
from depgraph.operators.ordinals import buckets_for, key_dictionary
from depgraph.operators.snapshots import earlier_keys, node_changes, snapshot_changes

SNAP = "snapshot_no int, snapshot_at timestamp, id string, repo_id string, type string, name string, file_path string, language string, line_start int, line_end int, file_hash string, loaded_at timestamp, bucket string, ordinal string, change_kind string"
T0 = datetime(2026, 1, 1)


@settings(max_examples=40, deadline=None)
@given(hs.sets(hs.integers(0, 300_000)), hs.sets(hs.integers(0, 300_000)), hs.booleans())
def test_bitmaps_are_sets(a, b, dense):
    if dense:
        a = a | set(range(1000, 9000))
        b = b | set(range(5000, 70_000))
    x, y = Bitmap(list(a)), Bitmap(list(b))
    assert x.and_not(y).to_array().tolist() == sorted(a - b)
    assert (x & y).to_array().tolist() == sorted(a & b)
    assert len(x) == len(a)


def test_dense_chunks_are_small():
    assert Bitmap(np.arange(65_536)).nbytes() == 8192


def snap_row(no, id_, loaded, **k):
    base = {"repo_id": "r", "type": "function", "name": "n", "file_path": "p", "language": "go", "line_start": 1, "line_end": 2, "file_hash": "ab"} | k
    return (no, None, id_, *(base[c] for c in ("repo_id", "type", "name", "file_path", "language", "line_start", "line_end", "file_hash")), loaded, "x", "y", "z")


def brute(rows):
    last = {}
    for r in rows:
        if r[0] is None or r[2] is None:
            continue
        k = (r[0], r[2])
        v = (r[11] is not None, r[11] or T0)
        if k not in last or v >= last[k][0]:
            last[k] = (v, (*r[3:10], r[10].lower() if r[10] else r[10]))
    nos = sorted({k[0] for k in last})
    out = set()
    for a, b in zip(nos, nos[1:]):
        old, new = ({i: v[1] for (n, i), v in last.items() if n == x} for x in (a, b))
        out |= {(b, i, "added") for i in new.keys() - old.keys()} | {(b, i, "removed") for i in old.keys() - new.keys()} | {(b, i, "changed") for i in new.keys() & old.keys() if new[i] != old[i]}
    return out


def test_changes_match_brute_force(spark):
    r = random.Random(3)
    rows, t = [], 0
    for no in (1, 2, 4):  # a number that was never delivered is passed over
        for i in range(400):
            for _ in range(r.choice((0, 1, 1, 1, 2))):
                t += 1
                rows.append(snap_row(no, r.choice((f"id{i}", f"id{i}", None)) if i % 50 == 0 else f"id{i}", T0 + timedelta(seconds=t), line_start=r.choice((1, 1, 1, None, 3)), file_hash=r.choice(("ab", "AB", "Ab", "cd", None)) if i % 3 == 0 else "ab", name=r.choice(("n", "n", None))))
    r.shuffle(rows)
    got = node_changes(spark.createDataFrame(rows, SNAP)).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == brute(rows)


def test_changes_with_ties_hot_ids_and_no_rows(spark):
    assert node_changes(spark.createDataFrame([], SNAP)).collect() == []
    assert node_changes(spark.createDataFrame([snap_row(1, "a", T0)], SNAP)).collect() == []
    tie = [snap_row(1, "a", T0, name="x"), snap_row(2, "a", T0, name="x"), snap_row(2, "a", T0, name="y"), snap_row(2, None, T0)] + [snap_row(2, "hot", None)] * 500
    a, b = (sorted(map(tuple, node_changes(spark.createDataFrame(t, SNAP)).collect())) for t in (tie, tie[::-1]))
    assert a == b and (2, "hot", "added") in a


def test_ordinals_persist(spark):
    first = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    d1 = key_dictionary(first, "id", buckets=2)
    old = {r["id"]: (r["bucket"], r["ordinal"]) for r in d1.collect()}
    known = spark.createDataFrame([(k, v[1]) for k, v in old.items()], "id string, ordinal bigint")
    more = spark.createDataFrame([(x,) for x in "bcdefgh"], "id string")
    new = {r["id"]: (r["bucket"], r["ordinal"]) for r in key_dictionary(more, "id", known, buckets=2).collect()}
    assert set(new) == set("abcdefgh") and all(new[k] == v for k, v in old.items())
    assert len(set(new.values())) == len(new)
    rows = [snap_row(1, "a", T0), snap_row(2, "b", T0)]
    got = {tuple(x) for x in snapshot_changes(spark.createDataFrame(rows, SNAP), ["name"], known=known, buckets=2).collect()}
    assert got == {(2, "b", "added"), (2, "a", "removed")}
    d2 = spark.createDataFrame([(k, *v) for k, v in new.items()], "id string, bucket int, ordinal bigint")
    wider = key_dictionary(more, "id", d2, buckets=8).collect()
    assert {r["id"]: r["ordinal"] for r in wider} == {k: v[1] for k, v in new.items()} and len({(r["bucket"], r["ordinal"]) for r in wider}) == len(new)
    assert buckets_for(10) == 256 and buckets_for(600_000_000) == 1024 and buckets_for(10, spark.createDataFrame([("a", 700, 0)], "id string, bucket int, ordinal bigint")) == 1024


def test_snapshots_numbered_by_day(spark):
    day = "snapshot_no date, " + SNAP.split(", ", 1)[1]
    rows = [snap_row(date(2026, 1, 3), "a", T0), snap_row(date(2026, 1, 9), "b", T0), snap_row(date(2026, 1, 9), "a", T0, name="m")]
    df = spark.createDataFrame(rows, day)
    want = {(date(2026, 1, 9), "b", "added"), (date(2026, 1, 9), "a", "changed")}
    assert {tuple(r) for r in node_changes(df).collect()} == want == {tuple(r) for r in node_changes(df, earlier_keys(df)).collect()}
    empty = df.where("false")
    assert node_changes(empty).collect() == [] and earlier_keys(empty).collect() == [] and node_changes(empty, earlier_keys(empty)).collect() == []


EDGE = "id string, repo_id string, source_id string, target_id string, n string, key string, key_column string"


def edges(n=3000, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = "hot" if r.random() < 0.4 else r.choice((None, *(f"t{j}" for j in range(200))))
        s = f"s{r.randrange(300)}"
        out.append((f"{s}::{t}::{r.randrange(3)}", r.choice(("r1", "r1", "r2", None)), s, t, "n", "k", "c"))
    return out + out[:50] + [(None, "r9", "s", "t", "n", "k", "c")]


def test_heavy_keys_and_counts(spark):
    rows = edges()
    df = spark.createDataFrame(rows, EDGE)
    least = lambda xs: min((x for x in xs if x is not None), default=None)
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[r[0]].append(r)
    one = [tuple(least([r[i] for r in rs]) for i in (1, 2, 3)) for rs in by.values()]
    counts = Counter((c, v) for o in one for c, v in zip(("repo_id", "source_id", "target_id"), o) if v is not None)
    columns = ["repo_id", "source_id", "target_id"]
    got = {(r[0], r[1]): r[2] for r in key_counts(distinct_edges(df, columns), columns).collect()}
    assert got.pop((None, None)) == len(one) and got == dict(counts)
    assert {(r[0], r[1]) for r in heavy_keys(df).collect()} == {k for k, n in counts.items() if n * 50 >= len(one)}
    pairs = Counter((o[2], o[1]) for o in one if o[1] is not None and o[2] is not None)
    for r in per_key(df, "target_id", "source_id", 2).collect():
        mine = {s: n for (t, s), n in pairs.items() if t == r["key"]}
        assert (r["n_rows"], r["n_values"]) == (sum(mine.values()), len(mine))
        assert [(x["value"], x["n"]) for x in r["top"]] == sorted(mine.items(), key=lambda x: (-x[1], x[0]))[:2]


def test_heavy_keys_of_nothing(spark):
    assert heavy_keys(spark.createDataFrame([], EDGE)).collect() == []
    assert heavy_keys(spark.createDataFrame([("a", None, None, None, "n", "k", "c")], EDGE)).collect() == []
    assert per_key(spark.createDataFrame([], EDGE), "target_id", "source_id").collect() == []


@pytest.mark.parametrize("share", [2, 50])
def test_exactly_at_the_share(spark, share):
    rows = [(str(i), f"r{i % share}", "s", "t", "", "", "") for i in range(share * 4)]
    assert {r["key_value"] for r in heavy_keys(spark.createDataFrame(rows, EDGE), ["repo_id"], share).collect()} == {f"r{i}" for i in range(share)}
