"""Problem 6: the whole corpus in ids of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; every function takes another folder as parameter.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk, and of the stretch in which neighbours must agree on a boundary.
CHUNK, OVERLAP = 2_048, 192
#: The pattern looks ahead this far at most, so boundaries closer to a chunk's end aren't trusted.
LOOKAHEAD = 4
#: Copies of one row that are written out at once, chunks sent to Spark at once, and rows that a Python worker turns into lists at once.
COPIES, HELD_CHUNKS, HELD_ROWS = 1_000, 256, 500


@lru_cache(4)
def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _pattern():
    return regex.compile(PATTERN)


def boundaries(text: str, base: int = 0) -> list[int]:
    """Where pre-tokens begin."""
    return [base + m.start() for m in _pattern().finditer(text)]


def cut_points(text: str, base: int = 0) -> list[int]:
    """Boundaries behind a visible character. Behind white space the pattern looks at what follows, so a text can't be cut there."""
    return [b for b in boundaries(text, base) if b > base and not text[b - base - 1].isspace()]


def resynchronise(before: list[int], after: list[int]) -> int | None:
    """The first position at which both chunks see a boundary; from there on they agree."""
    common = set(before) & set(after)
    return min(common) if common else None


def encode(text: str | None, folder: str = TOKENIZERS) -> list[int]:
    """Ids of a text without special tokens; their spellings in the text are ordinary text. [] for null and empty texts."""
    return encoding(folder).encode_ordinary(text) if text else []


def decode(ids: list[int], folder: str = TOKENIZERS) -> str:
    """The text again, by joining the raw bytes of the ids."""
    return encoding(folder).decode_bytes(ids).decode("utf-8")


@dataclass
class Chunk:
    """A chunk from ``start`` on, pre-tokenised and encoded by itself: its ids, and the boundaries in the overlaps with its neighbours with the number of ids before each."""

    k: int
    start: int
    stop: int
    total: int
    ids: list[int]
    head: list[int]
    head_ids: list[int]
    tail: list[int]
    tail_ids: list[int]


def encode_chunk(enc: tiktoken.Encoding, k: int, start: int, stop: int, total: int, part: str, overlap: int) -> Chunk:
    """part is the text from start to stop and the overlap behind it; text begins at 0 and ends at total."""
    cuts, end = cut_points(part, start), start + len(part)
    head = [c for c in cuts if start < c <= start + overlap] if start else []
    tail = [c for c in cuts if stop < c <= (end if end == total else end - LOOKAHEAD)] if stop < total else []
    ids, at = [], {}
    marks = sorted({*head, *tail})
    for a, b in zip([start, *marks], [*marks, end]):
        ids += enc.encode_ordinary(part[a - start : b - start])
        at[b] = len(ids)
    return Chunk(k, start, stop, total, ids, head, [at[c] for c in head], tail, [at[c] for c in tail])


def stitch(enc: tiktoken.Encoding, chunks: list[Chunk], overlap: int) -> list[int]:
    """Ids of the text that consecutive chunks cover, joined where the boundaries of neighbours resynchronise.

    The first chunk sees the true boundaries, and so does each next one from the cut on. Where two neighbours
    never meet (one pre-token longer than the overlap), the bytes of their ids are the text again, which is
    pre-tokenised from the last cut on with as many further chunks as it takes, twice as many each time.
    """
    out, now, begin, at, i, more = [], chunks[0], 0, chunks[0].start, 1, 1
    while i < len(chunks):
        cut = resynchronise(now.tail, chunks[i].head)
        if cut is not None:
            out += now.ids[begin : now.tail_ids[now.tail.index(cut)]]
            now, at = chunks[i], cut
            begin, i, more = now.head_ids[now.head.index(cut)], i + 1, 1
            continue
        text = enc.decode_bytes(now.ids[begin:]).decode("utf-8")
        for c in chunks[i : i + more]:
            text += enc.decode_bytes(c.ids).decode("utf-8")[at + len(text) - c.start :]
        i = min(len(chunks), i + more)
        now, begin, more = encode_chunk(enc, now.k, at, chunks[i - 1].stop, now.total, text, overlap), 0, 2 * more
    return out + now.ids[begin:]


def chunk_spans(total: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, stop) of the chunks of a text; what would lie in the overlap of the last one is part of it."""
    n = max(1, -(-(total - overlap) // chunk))
    return [(i * chunk, total if i == n - 1 else (i + 1) * chunk) for i in range(n)]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _encode_batches(folder: str, keep: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        for b in _slices(batches):
            each = (enc.encode_ordinary(t) if t else [] for t in b.column(keep).to_pylist())
            ids = pa.array(map(len, each), pa.int64()) if counts else pa.array(each, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keep)), ids], [*b.schema.names[:keep], "ids"])

    return run


def _cut_batches(keep: int, chunk: int, overlap: int):
    """Each text as rows of its overlapping chunks; every character is copied once, those of the overlaps twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(b):
            take = pa.array([r[0] for r in rows], pa.int64())
            cols = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.binary()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64()), (5, pa.int64()), (6, pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(keep)), *cols], [*b.schema.names[:keep], "text_key", "k", "start", "stop", "total", "part"])

        rows = []
        for b in batches:
            for row in range(b.num_rows):
                text = b.column(keep)[row].as_py()
                digest = hashlib.blake2b(text.encode("utf-8"), digest_size=16).digest()
                for k, (start, stop) in enumerate(chunk_spans(len(text), chunk, overlap)):
                    rows.append((row, digest, k, start, stop, len(text), text[start : stop + overlap]))
                    if len(rows) >= HELD_CHUNKS:
                        yield flush(b)
            if rows:
                yield flush(b)

    return run


_CHUNK = [("k", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(pa.int32())), ("head", pa.list_(pa.int64())), ("head_ids", pa.list_(pa.int32())), ("tail", pa.list_(pa.int64())), ("tail_ids", pa.list_(pa.int32()))]


def _chunk_batches(folder: str, keep: int, overlap: int):
    """(kept columns, text_key, copies, chunk) from (kept columns, text_key, copies, k, start, stop, total, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        for b in _slices(batches):
            done = [encode_chunk(enc, *row, overlap) for row in zip(*(b.column(keep + i).to_pylist() for i in range(2, 7)))]
            chunk = pa.StructArray.from_arrays([pa.array([getattr(c, n) for c in done], t) for n, t in _CHUNK], [n for n, _ in _CHUNK])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keep + 2)), chunk], [*b.schema.names[: keep + 2], "chunk"])

    return run


def _stitch_batches(folder: str, keep: int, overlap: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        for b in _slices(batches):
            each = (stitch(enc, [Chunk(**c) for c in chunks], overlap) for chunks in b.column(keep + 1).to_pylist())
            ids = pa.array(map(len, each), pa.int64()) if counts else pa.array(each, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keep + 1)), ids], [*b.schema.names[: keep + 1], "ids"])

    return run


def encode_documents(docs: DataFrame, *columns: str, text: str = "text", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP, counts: bool = False) -> DataFrame:
    """The given columns (doc_id if none) and ids of every row, or with ``counts`` the number of its ids.

    Null and empty texts have the ids []. Rows are kept as they are, repeated ones too. A text that one chunk
    holds is encoded where it is read. Longer ones are cut into overlapping chunks, which are spread over the
    tasks, pre-tokenised and encoded by themselves; neighbours are joined at the first position of their
    overlap where both see a pre-token begin (from there on they agree, as a pre-token depends on nothing
    before it). Where neighbours never meet, the text is won back from the bytes of their ids and encoded from
    the last cut on. docs is read twice; only texts longer than a chunk are shuffled, once as chunks (equal
    rows are put together there) and once as ids. Extra columns are ignored. Empty tables give no rows.
    """
    if chunk <= 2 * overlap:
        raise ValueError("a chunk must be longer than two overlaps")
    keep, kinds = list(columns or ("doc_id",)), dict(docs.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    ids = "ids bigint" if counts else "ids array<int>"
    size, n = F.coalesce(F.length(text), F.lit(0)), len(keep)
    short = docs.where(size <= chunk + overlap).select(*keep, text).mapInArrow(_encode_batches(folder, n, counts), f"{fields}, {ids}")
    parts = docs.where(size > chunk + overlap).select(*keep, text).mapInArrow(_cut_batches(n, chunk, overlap), f"{fields}, text_key binary, k int, start bigint, stop bigint, total bigint, part string")
    once = parts.groupBy(*keep, "text_key", "k").agg(F.count("*").alias("copies"), F.any_value("start").alias("start"), F.any_value("stop").alias("stop"), F.any_value("total").alias("total"), F.any_value("part").alias("part"))
    kind = "struct<k: int, start: bigint, stop: bigint, total: bigint, ids: array<int>, head: array<bigint>, head_ids: array<int>, tail: array<bigint>, tail_ids: array<int>>"
    chunks = once.select(*keep, "text_key", "copies", "k", "start", "stop", "total", "part").mapInArrow(_chunk_batches(folder, n, overlap), f"{fields}, text_key binary, copies bigint, chunk {kind}")
    whole = chunks.groupBy(*keep, "text_key").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list("chunk")).alias("chunks"))  # the chunks of one text
    long = whole.select(*keep, "copies", "chunks").mapInArrow(_stitch_batches(folder, n, overlap, counts), f"{fields}, copies bigint, {ids}")
    blocks = long.select(*keep, "ids", "copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))).alias("done"))
    again = blocks.select(*keep, "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("copies") - F.col("done"), F.lit(COPIES).cast("bigint")))).alias("copy"))
    return short.unionByName(again.drop("copy"))


def with_token_counts(docs: DataFrame, *columns: str, text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """The given columns and n_tokens, the number of ids of the whole text (0 for null and empty ones)."""
    return encode_documents(docs, *columns, text=text, folder=folder, counts=True).withColumnRenamed("ids", "n_tokens")
