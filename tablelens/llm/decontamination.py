"""Benchmark decontamination with suffix arrays of the training text.

Every shard of documents (a few MB of text) gets a suffix array over its words. Each suffix of each benchmark text
is searched in it by bisection; the interval of suffixes that share its first ``window`` words gives all
occurrences. Neighbouring occurrences on one diagonal make the longest verbatim matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelens.llm.common import ALNUM, row_bounds, shards, utf8, with_whole_rows, words_of

WINDOW = 10
BLOCK_BYTES = 16 << 20  # benchmark text that goes to the tasks at once
BITS, MASK = 21, (1 << 21) - 1
SHARD_BYTES = 6 << 20


class Items:
    """A block of benchmark texts as word hashes."""

    def __init__(self, names: list[str], texts: list[str | None], window: int = WINDOW):
        data, at = utf8(pa.array(texts, pa.string()))
        starts, _, self.hashes = words_of(data, at, ALNUM)
        first = row_bounds(starts, at)
        self.names = np.array(names, dtype=object)
        counts = np.diff(first)
        # one query per window start; a short text is one query
        begins, lengths, owner = [], [], []
        for i, n in enumerate(counts):
            size = min(n, window)
            tries = max(0, n - window) + 1 if n else 0
            begins.append(np.arange(first[i], first[i] + tries))
            lengths.append(np.full(tries, size))
            owner.append(np.full(tries, i))
        self.begin, self.length, self.owner = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (begins, lengths, owner))
        self.word = self.begin - first[self.owner] if len(self.begin) else self.begin


def suffix_array(codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word suffixes in order, and the first three words of each position as one number.

    ``codes`` are positive and below 2^21, ``left`` is the number of words up to the end of the document.
    Positions are sorted by three words, then ties by the rank of what follows, twice as far each time.
    """
    n = len(codes)
    key = codes << (2 * BITS)
    if n > 1:
        key[:-1] |= np.where(left[:-1] > 1, codes[1:], 0) << BITS
    if n > 2:
        key[:-2] |= np.where(left[:-2] > 2, codes[2:], 0)
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = key[sa]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth = 3
    while n:
        tied = np.flatnonzero(~head | np.append(~head[1:], False))
        if not len(tied) or not (left[sa[tied]] > depth).any():
            break
        at = sa[tied]
        group = rank[at]
        follow = np.where(left[at] > depth, rank[np.minimum(at + depth, n - 1)], -1)
        order = np.lexsort((follow, group))
        sa[tied] = at = at[order]
        group, follow = group[order], follow[order]
        new = np.ones(len(tied), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        head[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        depth *= 2
    return sa, key


def _first(sa, key, left, low, high, depth, bound) -> np.ndarray:
    """In each interval, the first suffix whose words from ``depth`` on are not below ``bound``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        at = np.flatnonzero(open_)
        middle = (low[at] + high[at]) // 2
        place = sa[middle]
        value = np.where(left[place] > depth, key[np.minimum(place + depth, len(key) - 1)], 0)
        below = value < bound[at]
        low[at[below]] = middle[below] + 1
        high[at[~below]] = middle[~below]
    return low


def intervals(sa, key, left, queries: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval of suffixes that begin with the first ``length`` words of each query (rows of word codes)."""
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(sa), np.int64)
    for depth in range(0, queries.shape[1], 3):
        live = np.flatnonzero((low < high) & (length > depth))
        if not len(live):
            break
        bounds = np.zeros(len(live), np.int64)
        slack = np.zeros(len(live), np.int64)
        for k in range(3):
            inside = length[live] > depth + k
            word = queries[live, depth + k] if depth + k < queries.shape[1] else np.zeros(len(live), np.int64)
            bounds |= np.where(inside, word, 0) << (BITS * (2 - k))
            slack |= np.where(inside, 0, MASK) << (BITS * (2 - k))
        start = _first(sa, key, left, low[live], high[live], depth, bounds)
        high[live] = _first(sa, key, left, start, high[live], depth, (bounds | slack) + 1)
        low[live] = start
    return low, high


def occurrences(data: np.ndarray, at: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first words per row, query, position)`` for every occurrence of a window in a shard."""
    starts, _, hashes = words_of(data, at, ALNUM)
    first = row_bounds(starts, at)
    empty = np.zeros(0, np.int64)
    if not len(hashes) or not len(items.begin):
        return first, empty, empty
    codes, known = pd.factorize(hashes)
    if len(known) >= MASK - 1:  # a giant text: cut the vocabulary to words of the benchmark, others stay apart from it
        known = np.unique(items.hashes)
        codes = pd.Index(known).get_indexer(hashes)
        codes[codes < 0] = len(known)
        if len(known) >= MASK - 1:
            raise ValueError("a benchmark block has too many distinct words")
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][row] - np.arange(len(hashes))
    sa, key = suffix_array(codes.astype(np.int64) + 1, left)
    bench = pd.Index(known).get_indexer(items.hashes).astype(np.int64) + 1
    bench[bench == 0] = MASK  # a word that the shard does not have
    reach = int(items.length.max())
    padded = np.concatenate((bench, np.zeros(reach, np.int64)))
    queries = padded[items.begin[:, None] + np.arange(reach)]
    low, high = intervals(sa, key, left, queries, items.length)
    found = np.flatnonzero(low < high)
    counts = (high - low)[found]
    query = np.repeat(found, counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first, query, sa[np.repeat(low[found], counts) + step]


def _covered(first: np.ndarray, position: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Words of each row inside any occurrence."""
    change = np.zeros(first[-1] + 1, np.int64)
    np.add.at(change, position, 1)
    np.add.at(change, position + length, -1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(change)[:-1] > 0)))
    return np.diff(hit[first])


def _items_by_row(first: np.ndarray, query: np.ndarray, position: np.ndarray, items: Items) -> pa.Array:
    row = np.searchsorted(first, position, side="right") - 1
    pairs = np.unique(np.stack((row, items.owner[query])), axis=1) if len(row) else np.zeros((2, 0), np.int64)
    at = np.searchsorted(pairs[0], np.arange(len(first)))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(items.names[pairs[1]].tolist(), pa.string()))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list[Items]:
    """The benchmark in blocks of about ``BLOCK_BYTES`` bytes: a stated query set, sent block by block."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text_col}`").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    out = []
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        got = part.orderBy("i", "t").toPandas()
        out.append(Items(got["i"].tolist(), got["t"].tolist(), window))
    return out


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, doc_word, item_word, n_words``: maximal verbatim matches of at least a window.

    Word positions count from 0. Windows that follow one another in both texts are joined.
    """
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark, item_col, item_text, window):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                for part, data, at in shards(batch, batch.column(1), SHARD_BYTES):
                    first, query, position = occurrences(data, at, items)
                    row = np.searchsorted(first, position, side="right") - 1
                    owner, word = items.owner[query], items.word[query]
                    order = np.lexsort((position, position - word, owner, row))
                    row, owner, word, position, size = (x[order] for x in (row, owner, word, position, items.length[query]))
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(position) != 1) | (np.diff(word) != 1)
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(row)) - 1 if len(row) else begin
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(row[begin])), pa.array(items.names[owner[begin]].tolist(), pa.string()),
                        pa.array(position[begin] - first[row[begin]]), pa.array(word[begin]), pa.array(position[end] + size[end] - position[begin]),
                    ], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        kind = docs.schema[id_col].dataType.simpleString()
        found = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def _annotated(rows: DataFrame, text: str, benchmark: DataFrame, item_col: str, item_text: str, window: int) -> DataFrame:
    """``rows`` with ``n_words``, ``_spans`` (hit word ranges) or ``n_hit``, and ``_items``."""
    spark = rows.sparkSession
    blocks = _blocks(benchmark, item_col, item_text, window)
    sent = [spark.sparkContext.broadcast(b) for b in blocks]
    kept = [c for c in rows.columns if c != text]
    at_text = rows.columns.index(text)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in shards(batch, batch.column(at_text), SHARD_BYTES):
                positions, lengths, lists = [], [], []
                for b in sent:
                    first, query, position = occurrences(data, at, b.value)
                    positions.append(position)
                    lengths.append(b.value.length[query])
                    lists.append(_items_by_row(first, query, position, b.value))
                hit = _covered(first, np.concatenate(positions), np.concatenate(lengths))
                names = lists[0] if len(lists) == 1 else pa.array([sorted(set().union(*x)) for x in zip(*(y.to_pylist() for y in lists))], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(np.diff(first)), pa.array(hit), names], names=[*kept, "n_words", "n_hit", "_items"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{fields}, n_words long, n_hit long, _items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row of ``docs``.

    NULL and empty texts have no words and no hits. A benchmark text of fewer words than a window is searched
    whole, one without words never. Item ids count once however often they occur; a NULL item id is the empty
    id. Rows are handled one by one, so repeated rows and NULL ids give rows of their own. Empty tables give an
    empty result or no hits.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    rows = _annotated(slim, "_text", benchmark, item_col, item_text, window)
    names = F.array_sort(F.array_distinct("_items"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    rows = _annotated(with_whole_rows(docs, F.col(f"`{text_col}`").alias("_text")), "_text", benchmark, "item_id", "text", window)
    return rows.where("n_hit = 0").select("_row.*")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' '))) AS g FROM b WHERE len(w) > 0),
m AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m),
h AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND array_to_string(list_slice(dw.w, dw.i, dw.i + dw.m - 1), ' ') = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""
