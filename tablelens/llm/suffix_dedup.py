"""Repeated passages by sparse suffix arrays.

Only suffixes at minimiser positions are kept: of ``WINDOW`` consecutive ``GRAM``-word grams, the one with the least
hash. Every passage of ``MIN_WORDS`` words holds at least one, and equal passages hold the same. The suffixes are
sorted by their first gram over all machines, neighbours are compared, and those that meet another document are
extended: each 50-word stretch around such a position (so many words to the left, the rest to the right) is compared
with those of its neighbours. The result is exact: a word is reported if and only if it lies in a stretch of
``MIN_WORDS`` words that another document has too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelens.llm.common import NOT_SPACE, row_bounds, shards, signed, utf8, windows, words_of
from tablelens.session import materialize

MIN_WORDS = 50
GRAM = 16
_PLACE = np.uint64((1 << 24) - 1)


def minimisers(hashes: np.ndarray, first: np.ndarray, size: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(gram hash, position, first stretch, last stretch, row)`` of the selected positions of all rows.

    A stretch is ``size`` words from a start on; position and stretches are word indexes in ``hashes``. The least
    gram of a stretch is taken, the leftmost of equals. Blocks keep the place in 24 bits beside 40 bits of hash.
    """
    span = size - gram + 1
    grams = windows(hashes, gram)
    parts = []
    block = (1 << 24) - span - 1
    for a in range(0, max(0, len(grams) - span + 1), block):
        part = grams[a : a + block + span - 1]
        low = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        rest = span - reach
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        parts.append((low & _PLACE).astype(np.int64) + a)
    anchor = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    row = np.searchsorted(first, np.arange(len(anchor)), side="right") - 1
    inside = np.flatnonzero(np.arange(len(anchor)) + size <= first[1:][row]) if len(anchor) else anchor
    anchor, row = anchor[inside], row[inside]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(anchor)) - 1 if len(begin) else begin
    return grams[anchor[begin]], anchor[begin], inside[begin], inside[end], row[begin]


def _meets(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For sorted groups: the neighbours of the group include another key."""
    if not len(group):
        return np.zeros(0, bool)
    head = np.ones(len(group), bool)
    head[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(head)
    differs = np.minimum.reduceat(key, begin) != np.maximum.reduceat(key, begin)
    return np.repeat(differs, np.diff(np.append(begin, len(group))))


def _positions(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``gram, key, pos, a, b``: the kept suffixes of ``docs(key, _text)``; ``a`` to ``b`` are the stretches around."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in shards(batch, batch.column(1)):
                starts, _, hashes = words_of(data, at, NOT_SPACE)
                first = row_bounds(starts, at)
                value, pos, a, b, row = minimisers(hashes, first, size, gram)
                base = first[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(value)), part.column(0).take(pa.array(row)), pa.array((pos - base).astype(np.int32)), pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))],
                    names=["gram", "key", "pos", "a", "b"],
                )

    return docs.mapInArrow(run, "gram long, key long, pos int, a int, b int")


def _repeated(suffixes: DataFrame) -> DataFrame:
    """Suffixes whose gram also begins a suffix of another document: ``key, a, b``.

    Sorted by range, so a frequent gram is spread over tasks. A gram at the edge of a task may go on in the next
    one; the tasks report the keys of their edge grams, and rows that hang on them are decided afterwards.
    """
    ordered = suffixes.select("gram", "key", "a", "b").repartitionByRange("gram", "key", "a").sortWithinPartitions("gram", "key", "a")

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        gram, key, a, b = (rows.column(c).to_numpy() for c in ("gram", "key", "a", "b"))
        hit = _meets(gram, key)
        edge = (gram == gram[0]) | (gram == gram[-1])
        for x in {gram[0], gram[-1]}:
            own = key[gram == x]
            yield _rows([x] * 2, [own.min(), own.max()], [-1] * 2, [-1] * 2, [2] * 2)
        for kind, pick in ((1, np.flatnonzero(hit)), (0, np.flatnonzero(edge & ~hit))):
            yield _rows(gram[pick], key[pick], a[pick], b[pick], np.full(len(pick), kind))

    def _rows(gram, key, a, b, kind):
        return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(key, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(kind, pa.int32())], names=["gram", "key", "a", "b", "kind"])

    found = materialize(ordered.mapInArrow(run, "gram long, key long, a int, b int, kind int"))
    # two rows per task and edge at most
    shared = found.where("kind = 2").groupBy("gram").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi")).where("_lo <> _hi").select("gram")
    late = found.where("kind = 0").join(shared, "gram", "left_semi")
    return found.where("kind = 1").unionByName(late).select("gram", "key", "a", "b")


def _stretches(docs: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """``gram, key, a, around``: hashes of all stretches around each repeated position, from the joined texts."""
    lists = repeated.groupBy("key").agg(F.collect_list(F.struct("gram", "a", "b")).alias("_at"))  # no longer than the text
    joined = docs.join(lists, "key").select("key", "_text", "_at")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in shards(batch, batch.column(1)):
                starts, _, hashes = words_of(data, at, NOT_SPACE)
                first = row_bounds(starts, at)
                whole = signed(windows(hashes, size))
                lists = part.column(2)
                flat = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                gram, a, b = (flat.field(n).to_numpy() for n in ("gram", "a", "b"))
                # pieces, so that one giant text does not make one giant message
                for i in range(0, len(row), 20_000):
                    r, x, y = row[i : i + 20_000], a[i : i + 20_000].astype(np.int64), b[i : i + 20_000].astype(np.int64)
                    n = y - x + 1
                    offset = np.concatenate(([0], np.cumsum(n)))
                    place = np.arange(offset[-1]) - np.repeat(offset[:-1], n) + np.repeat(x + first[r], n)
                    around = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(whole[place]))
                    yield pa.RecordBatch.from_arrays([pa.array(gram[i : i + 20_000]), part.column(0).take(pa.array(r)), pa.array(x.astype(np.int32)), around], names=["gram", "key", "a", "around"])

    return joined.mapInArrow(run, "gram long, key long, a int, around array<long>")


def _extended(stretches: DataFrame) -> DataFrame:
    """Stretches ``key, start`` that another document has too. Sorted and decided like the suffixes themselves."""
    ordered = stretches.repartitionByRange("gram", "key", "a").sortWithinPartitions("gram", "key", "a")

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        gram, key, a = (rows.column(c).to_numpy() for c in ("gram", "key", "a"))
        lists = pa.concat_arrays(rows.column("around").chunks)
        n = lists.value_lengths().to_numpy()
        value = lists.flatten().to_numpy()
        offset = np.cumsum(n) - n
        start = np.arange(len(value)) - np.repeat(offset, n) + np.repeat(a, n)
        edge = np.repeat((gram == gram[0]) | (gram == gram[-1]), n)
        key = np.repeat(key, n)
        order = np.lexsort((key, value))
        value, key, start, edge = value[order], key[order], start[order], edge[order]
        hit = _meets(value, key)
        at_edge = np.flatnonzero(edge)
        if len(at_edge):
            v, k = value[at_edge], key[at_edge]
            begin = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            yield _rows(np.repeat(v[begin], 2), np.stack((np.minimum.reduceat(k, begin), np.maximum.reduceat(k, begin)), 1).ravel(), np.full(2 * len(begin), -1), 2)
        for kind, pick in ((1, np.flatnonzero(hit)), (0, np.flatnonzero(edge & ~hit))):
            yield _rows(value[pick], key[pick], start[pick], kind)

    def _rows(value, key, start, kind):
        return pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(key, pa.int64()), pa.array(start.astype(np.int32)), pa.array(np.full(len(value), kind, np.int32))], names=["value", "key", "start", "kind"])

    found = materialize(ordered.mapInArrow(run, "value long, key long, start int, kind int"))
    shared = found.where("kind = 2").groupBy("value").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi")).where("_lo <> _hi").select("value")
    late = found.where("kind = 0").join(shared, "value", "left_semi")
    return found.where("kind = 1").unionByName(late).select("key", "start")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``doc_id, start_word, end_word, n_words``: the words of each document that lie in passages of at least
    ``min_words`` words which another document has too; touching passages are one row, words count from 0.

    Words are what white space separates, A-Z lower-cased. NULL, empty and shorter texts have no passage. Rows with
    equal id and text are one document; equal texts under different ids (or NULL and another) repeat each other.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("_text"))
    named = named.withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("_text")))
    keyed = named.select("key", "_text")
    repeated = materialize(_repeated(_positions(keyed, min_words, gram)))
    # rows with equal id and text come up with the same stretches under the same key
    starts = _extended(_stretches(keyed, repeated, min_words))
    lists = materialize(starts.groupBy("key").agg(F.array_sort(F.collect_set("start")).alias("_starts")))

    def spans(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists_ = batch.column(1)
            value = lists_.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lists_.value_lengths().to_numpy())
            new = np.ones(len(value), bool)
            new[1:] = (row[1:] != row[:-1]) | (value[1:] - value[:-1] > min_words)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(value)) - 1 if len(begin) else begin
            low, high = value[begin], value[end] + min_words
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[begin])), pa.array(low), pa.array(high)], names=["_k", "start_word", "end_word"])

    found = lists.mapInArrow(spans, "_k long, start_word long, end_word long")
    ids = named.select("key", "doc_id").dropDuplicates(["key"])
    out = found.join(ids, F.col("_k") == F.col("key"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS i, unnest(list_transform(range(0, len(w) - 49), lambda i: md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')))) AS h FROM d WHERE len(w) >= 50),
r AS (SELECT h FROM s GROUP BY h HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT DISTINCT doc_id, i FROM s JOIN r USING (h)),
g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM f),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, max(i) + 50 - min(i) AS n_words FROM k GROUP BY doc_id, run"""
