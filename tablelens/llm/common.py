"""Shared pieces: row handling, word hashing in numpy, shingles, connected components.

Text functions work on the UTF-8 bytes of an Arrow column. Words are found and hashed with array operations, so
no Python string is made per word; 64-bit hashes stand for words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablelens.session import materialize

SPACES = [0x20, *range(0x09, 0x0E)]
SEGMENT = 1 << 19  # bytes whose temporary arrays are held at once
SHARD = 1 << 21  # bytes of text handed to one call of a kernel
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5


def class_table(members: Callable[[int], bool]) -> np.ndarray:
    """256 flags: the bytes that belong to words."""
    return np.array([members(b) for b in range(256)])


NOT_SPACE = class_table(lambda b: b not in SPACES)
ALNUM = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def shards(batch: pa.RecordBatch, text: pa.Array, limit: int = SHARD) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of a batch with at most ``limit`` bytes of text (or one row)."""
    data, at = utf8(text)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, batch.num_rows)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, SEGMENT + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that their order and bits are uniform."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, at: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and 64-bit hash of every word, A-Z lower-cased; words do not cross rows."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts, ends, hashes = [], [], []
    a = 0
    while a < n:
        b = min(n, a + SEGMENT)
        while b < n and not edge[b] and members[_LOWER[data[b]]] and members[_LOWER[data[b - 1]]]:
            b += 1  # a word is never cut
        text = _LOWER[data[a:b]]
        inside = members[text]
        cut = edge[a : b + 1].copy()
        cut[0] = cut[-1] = True
        start = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
        end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        up, down = _powers(b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        starts.append(start + a)
        ends.append(end + a)
        a = b
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def row_bounds(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the first word of every row, and the number of words at the end."""
    return np.searchsorted(starts, at)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on (the last positions are short)."""
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * _BASE % (1 << 64)
        out += hashes[k : k + len(out)] * np.uint64(factor)
    return mix(out)


def row_sets(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, ascending within the row, and where each row begins.

    Rows with fewer words have one shingle, their whole sequence; rows without words have none.
    """
    starts, _, hashes = words_of(data, at, NOT_SPACE)
    first = row_bounds(starts, at)
    counts = np.diff(first)
    n_rows = len(counts)
    long = counts >= size
    begin = np.concatenate(([0], np.cumsum(np.where(long, counts - size + 1, counts > 0))))
    values = np.empty(begin[-1], np.uint64)
    inside = np.repeat(long, np.diff(begin))
    row = np.repeat(np.arange(len(counts)), np.diff(begin))[inside]
    values[inside] = windows(hashes, size)[first[:-1][row] + np.flatnonzero(inside) - begin[row]]
    short = np.flatnonzero((counts > 0) & ~long)
    if len(short):
        values[begin[short]] = mix(np.array([int(windows(hashes[first[r] : first[r + 1]], counts[r])[0]) ^ int(counts[r]) for r in short], np.uint64))
    # a sort per row is faster than one of all values by row
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[begin[:-1][np.diff(begin) > 0]] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[begin]


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long, with the same order as unsigned."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def map_rows(docs: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run an Arrow kernel over the batches of ``docs``."""

    def run(batches):
        for batch in batches:
            yield from kernel(batch)

    return docs.mapInArrow(run, schema)


def with_whole_rows(docs: DataFrame, *cols: Column) -> DataFrame:
    """The row as struct ``_row`` beside working columns, so that no name of the caller can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *cols)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(id, component)`` per node, component = smallest id.

    Alternates hanging the larger neighbours and the smaller neighbours of a node on its smallest one, until
    nothing changes; each round is written to the shared folder. No node gathers its neighbours in a list.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(both)
    while True:
        facing = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = facing.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = facing.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialize(large)
        root = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = large.join(root, "a").select(F.col("b").alias("a"), F.col("low").alias("b"), F.col("a").alias("from"))
        small = hung.where("a <> b").select("a", "b").unionByName(hung.select(F.col("from").alias("a"), "b")).distinct()
        following = materialize(small)
        if _digest(following) == _digest(current):
            return following.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                following.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        current = following


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
