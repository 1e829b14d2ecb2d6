"""N-gram Jaccard join with signature trees.

Documents whose word-shingle sets have a Jaccard similarity of at least 0.75 are linked. Two steps:

* Blocking that loses nothing. Two linked sets share one of their first quarter of shingles in any fixed order, and
  so many of them that a count rules most other pairs out; what can follow is bounded by the places of the last shared
  shingle and by the prefix that ends first. The order is by hash, with frequent shingles last, so that a common
  passage makes no candidates. Candidates fall into clusters.
* In each cluster a signature tree: leaves hold a few sets, nodes the OR of the token bitmaps and the range of sizes
  below. The tree is traversed against itself; a pair of nodes goes when its sizes cannot match, when the greatest
  overlap that bitmaps and sizes allow is too small, or when everything below is linked already. What is left is
  compared exactly.

Equal sets are one node of the graph from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelens.llm.common import components, mix, row_sets, shards, signed, with_whole_rows
from tablelens.session import materialize

SIZE = 5
PERCENT = 75
HOT = 64  # lists longer than this are frequent
HOT_LIMIT = 1_000_000  # frequent shingles sent to the tasks: 8 MB at most; the bar is raised until they fit
ROUNDS = 3
BLOCK = 4096  # sets of a cluster in one task
STEPS = (1, 16, 256, 0)  # pairs judged between two groups of a split cluster before they are looked at anew; 0: all
CHAINED = 1 << 30  # overlap given to neighbours in a long hot list: more than any pair needs
LEAF = 8
SHARD = 1 << 21
_TOP = np.uint64(1 << 63)


def needed_overlap(a, b, percent: int = PERCENT):
    """Least intersection with ``100 * i >= percent * (a + b - i)``."""
    return -(-percent * (a + b) // (100 + percent))


def set_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit id per set: the sum of scrambled shingles and the size."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(values + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)))
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


class Frequent:
    """Frequent shingles, sorted, and their places in the order: the rarest first."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        order = np.argsort(values)
        self.values = values[order]
        self.rank = np.empty(len(values), np.int64)
        self.rank[np.lexsort((self.values, counts[order]))] = np.arange(len(values))

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are frequent, and the places of these."""
        if not len(self.values) or not len(values):
            return np.zeros(len(values), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        hit = self.values[at] == values
        return hit, self.rank[at[hit]]


NONE = Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def prefix_mask(values: np.ndarray, at: np.ndarray, frequent: Frequent, percent: int = PERCENT, stretch: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which values are in the prefix of their row, which are hot, the place of each in its row and the rank of the hot
    ones. Rows come sorted by hash; hot values stand behind the others of their row, the rarest first. Prefixes of rows
    with hot values are ``stretch`` times as long."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    length = n - -(-percent * n // 100) + 1
    is_hot, rank = frequent.find(values)
    cool_before = np.concatenate(([0], np.cumsum(~is_hot)))
    hot_before = np.arange(len(values) + 1) - cool_before
    length = np.where(np.diff(hot_before[at]) > 0, stretch, 1) * length
    first = at[:-1][row]
    cool = np.diff(cool_before[at])[row] if len(n) else row
    place = cool_before[:-1] - cool_before[first]
    if len(rank):
        hot_at = np.flatnonzero(is_hot)
        order = hot_at[np.lexsort((rank, row[hot_at]))]
        place[order] = cool[order] + np.arange(len(order)) - hot_before[first[order]]
    return place < length[row], is_hot, place, rank


def _sets(batches, limit: int = SHARD) -> Iterator[tuple]:
    for batch in batches:
        for part, data, at in shards(batch, batch.column(1), limit):
            yield part, *row_sets(data, at, SIZE)


def light_sets(docs: DataFrame) -> DataFrame:
    """``key, n, sid`` per row of ``docs(key, _text)``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part, values, at in _sets(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(signed(set_ids(values, at)))], names=["key", "n", "sid"])

    return docs.mapInArrow(run, "key long, n long, sid long")


def frequent_shingles(docs: DataFrame, percent: int, hot: int) -> Frequent:
    """Shingles in more than ``hot`` prefixes. They only order the prefixes: any set gives right results.

    Moving them last lengthens prefixes, which can bring up others, so the next round counts further into the texts
    that have frequent shingles.
    Every round also counts the known ones in all documents, which puts the rarest of them first: a family of
    copies then meets by its own shingles and not by a passage that it shares with others.
    """
    known, before, counts = NONE, None, {}
    for level in range(ROUNDS):
        def run(batches, known=known, before=before, reach=2**level) -> Iterator[pa.RecordBatch]:
            for _, values, at in _sets(batches):
                mask, is_hot, _, _ = prefix_mask(values, at, known, percent, reach)
                mask &= ~is_hot
                if before is not None:
                    mask &= ~prefix_mask(values, at, before, percent, reach // 2)[0]
                again, times = np.unique(values[is_hot], return_counts=True)
                both, n = np.concatenate((values[mask], again)), np.concatenate((np.ones(mask.sum(), np.int64), times))
                yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(n)], names=["h", "c"])

        found = materialize(docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > hot))
        bar = hot
        while found.where(F.col("c") > bar).count() > HOT_LIMIT:
            bar *= 2
        got = found.where(F.col("c") > bar).toPandas()
        fresh = len(set(got["h"]) - set(counts))
        counts |= dict(zip(got["h"], got["c"]))
        before = known
        known = Frequent(np.array(list(counts), np.int64).view(np.uint64), np.array(list(counts.values()), np.int64))
        if not fresh:
            break
    return known


def _postings(docs: DataFrame, frequent: Frequent, percent: int) -> DataFrame:
    """``h, sid, n, spot, end``: prefix shingles of every set; ``spot`` is twice the place in the order, plus 1 if this
    one is hot, ``end`` tells where in the order of all shingles the prefix ends. Equal sets of a shard are sent once."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for _, values, at in _sets(batches):
            n, sid = np.diff(at), set_ids(values, at)
            own = np.zeros(len(n), bool)
            own[np.unique(sid, return_index=True)[1]] = True
            mask, is_hot, place, rank = prefix_mask(values, at, sent.value, percent)
            row = np.repeat(np.arange(len(n)), n)
            step = (values >> np.uint64(34)).astype(np.int32)  # 30 bits; hot ones stand behind
            step[is_hot] = (1 << 30) + rank
            last = np.flatnonzero(place == (n - -(-percent * n // 100))[row])
            end = np.zeros(len(n), np.int32)
            end[row[last]] = step[last]
            pick = np.flatnonzero(mask & own[row])
            r = row[pick]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[pick].view(np.int64)), pa.array(signed(sid[r])), pa.array(n[r].astype(np.int32)), pa.array((2 * place[pick] + is_hot[pick]).astype(np.int32)), pa.array(end[r])],
                names=["h", "sid", "n", "spot", "end"],
            )

    return docs.mapInArrow(run, "h long, sid long, n int, spot int, end int")


def _left_over(rest, left, end, i, j) -> np.ndarray:
    """Most shingles that ``i`` and ``j`` can share beyond those counted. ``rest`` follow the prefix, ``left`` follow the
    last one counted.

    Where the prefix of ``i`` ends first, a shared shingle up to its end is in both prefixes and counted; what else is
    shared lies in ``rest`` of ``i`` and in ``left`` of ``j``. Equal ends may stand for either order.
    """
    first, second = np.minimum(rest[i], left[j]), np.minimum(rest[j], left[i])
    return np.where(end[i] < end[j], first, np.where(end[i] > end[j], second, np.maximum(first, second)))


def _list_pairs(begin: np.ndarray, length: np.ndarray, hot_list: np.ndarray, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Index pairs of the members of each list: all of them, or near neighbours of long hot lists (``False``)."""
    short = ~(hot_list & (length > bound))
    for size in np.unique(length[short]):
        if size < 2:
            continue
        at = begin[short & (length == size)]
        for gap in range(1, size):
            i = (at[:, None] + np.arange(size - gap)).ravel()
            yield i, i + gap, True
    for b, n in zip(begin[~short], length[~short]):
        for gap in (1, 2, 3):
            i = np.arange(b, b + n - gap)
            yield i, i + gap, False


def _candidates(postings: DataFrame, percent: int, hot: int) -> DataFrame:
    """``a, b, c, need`` rows, one per shared shingle, and with ``need = -1`` the members ``(h, sid, n)`` of hot lists.

    ``c`` counts towards the overlap of two prefixes. What else two sets can share is bounded (``_left_over``), best by
    the last shingle they share, so a linked pair has at least the largest ``need`` of its rows. The members of a long
    hot list are chained to their neighbours in size, which puts them all into one cluster (a gap in sizes that no link
    can cross may part them); so a pair that shares such a list needs no count, and for any other all counts are there.
    """
    placed = postings.repartition("h").sortWithinPartitions("h", "n", "sid")

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        h, sid, n, spot, end = (rows.column(c).to_numpy() for c in ("h", "sid", "n", "spot", "end"))
        new = np.append(True, (h[1:] != h[:-1]) | (sid[1:] != sid[:-1]))
        h, sid, n, place, is_hot, end = h[new], sid[new], n[new].astype(np.int64), spot[new].astype(np.int64) // 2, spot[new] % 2 == 1, end[new]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        length = np.diff(np.append(begin, len(h)))
        rest, left = -(-percent * n // 100) - 1, n - place - 1
        for i, j, whole in _list_pairs(begin, length, is_hot[begin], hot):
            fit = 100 * n[i] >= percent * n[j]  # sorted by size
            i, j = i[fit], j[fit]
            need = np.zeros(len(i), np.int64)
            if whole:
                total = needed_overlap(n[i], n[j], percent)
                fit = np.minimum(place[i], place[j]) + 1 + np.minimum(left[i], left[j]) >= total
                i, j, total = i[fit], j[fit], total[fit]
                need = np.maximum(total - _left_over(rest, left, end, i, j), 0)
            first = np.minimum(sid[i], sid[j])
            for k in range(0, len(i), 200_000):
                s = slice(k, k + 200_000)
                yield _rows(first[s], np.maximum(sid[i], sid[j])[s], np.full(len(first[s]), 1 if whole else CHAINED), need[s])
        for b, m in zip(begin, length):
            if is_hot[b] and m > hot:
                yield _rows(h[b : b + m], sid[b : b + m], n[b : b + m], np.full(m, -1))

    def _rows(a, b, c, need):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c.astype(np.int32)), pa.array(need.astype(np.int32))], names=["a", "b", "c", "need"])

    return placed.mapInArrow(run, "a long, b long, c int, need int")


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


class SignatureTree:
    """Sets sorted by size; node ``i`` of a level covers nodes ``2i`` and ``2i + 1`` below, leaves cover ``LEAF`` sets."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
        self.sets = [sets[i] for i in self.order]
        self.root = list(range(len(sets)))
        bits = 1 << max(6, min(16, int(4 * len(self.sets[-1])).bit_length()))
        words = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            place = s.view(np.uint64) >> np.uint64(64 - bits.bit_length() + 1)
            np.bitwise_or.at(words[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        pop = np.bitwise_count(words).sum(axis=1).astype(np.int64)
        size = np.array([len(s) for s in self.sets])
        cut = np.arange(0, len(sets), LEAF)
        level = (np.bitwise_or.reduceat(words, cut, axis=0), np.minimum.reduceat(size, cut), np.maximum.reduceat(size, cut), np.minimum.reduceat(pop, cut))
        self.levels = [level]
        while len(level[1]) > 1:
            cut = np.arange(0, len(level[1]), 2)
            level = (np.bitwise_or.reduceat(level[0], cut, axis=0), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.minimum.reduceat(level[3], cut))
            self.levels.append(level)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def possible(self, depth: int, x: int, y: int) -> bool:
        """Can a set below ``x`` be linked with one below ``y``? (``x <= y``, so sizes below ``x`` are not larger.)"""
        bitmap, low, high, pop = self.levels[depth]
        if 100 * high[x] < self.percent * low[y]:
            return False
        if x == y:
            return True
        common = int(np.bitwise_count(bitmap[x] & bitmap[y]).sum())
        most = min(high[x] - max(0, pop[x] - common), high[y] - max(0, pop[y] - common))
        return most >= needed_overlap(low[x], low[y], self.percent)

    def _members(self, depth: int, x: int) -> range:
        width = LEAF << depth
        return range(x * width, min((x + 1) * width, len(self.sets)))

    def links(self) -> list[tuple[int, int]]:
        """Links (positions in the caller's list) that connect every group of linked sets."""
        out = []
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            depth, x, y = stack.pop()
            if not self.possible(depth, x, y):
                continue
            if depth == 0:
                self._compare(x, y, out)
                continue
            width = LEAF << depth
            if x != y and len({self.find(i) for i in self._members(depth, x)} | {self.find(i) for i in self._members(depth, y)}) == 1:
                continue
            below = len(self.levels[depth - 1][1])
            pairs = [(a, b) for a in (2 * x, 2 * x + 1) for b in (2 * y, 2 * y + 1) if a <= b < below]
            # children against themselves first: most links are near in size
            stack.extend((depth - 1, a, b) for a, b in sorted(pairs, key=lambda p: p[1] - p[0], reverse=True))
        return out

    def _compare(self, x: int, y: int, out: list) -> None:
        for i in self._members(0, x):
            for j in self._members(0, y):
                if i < j and 100 * len(self.sets[i]) >= self.percent * len(self.sets[j]):
                    a, b = self.find(i), self.find(j)
                    if a != b and _overlap(self.sets[i], self.sets[j]) >= needed_overlap(len(self.sets[i]), len(self.sets[j]), self.percent):
                        self.root[max(a, b)] = min(a, b)
                        out.append((self.order[i], self.order[j]))


def _tree_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` found by one tree per ``(cluster, part)``."""

    def join(table: pa.Table) -> pa.Table:
        sid = table.column("sid").to_numpy()
        lists = table.column("shingles").combine_chunks()
        flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        found = SignatureTree([flat[a:b] for a, b in zip(at[:-1], at[1:])], percent).links()
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.minimum(sid[i], sid[j])), "b": pa.array(np.maximum(sid[i], sid[j]))})

    return sets.groupBy("cluster", "part").applyInArrow(join, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    met = pairs.select("a", "b").join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("x", "y"))
    return met.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _with_components(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are not connected yet, with ``ca`` and ``cb``."""
    ends = pairs
    for end in ("a", "b"):
        c = comps.select(F.col("id").alias(end), F.col("component").alias(f"_c{end}"))
        ends = ends.join(c, end, "left").withColumn(f"c{end}", F.coalesce(f"_c{end}", end)).drop(f"_c{end}")
    return ends.where("ca <> cb")


def _hot_pairs(members: DataFrame, homes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Unconnected pairs of hot lists from different parts of a cluster that are near in size: what lies outside the
    largest group of a list, against the list. Sizes meet by classes of ratio 3/4, so that far sizes do not."""
    named = members.join(homes.withColumnRenamed("id", "sid"), "sid").join(comps.withColumnRenamed("id", "sid"), "sid", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "sid")))
    groups = named.groupBy("h", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = groups.groupBy("h").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    named = materialize(named.join(largest, "h"))
    step = float(np.log(100 / percent))
    klass = F.floor(F.log(F.col("n").cast("double")) / step)
    outside = named.where("component <> main").select("h", F.col("sid").alias("s"), F.col("n").alias("ns"), F.col("component").alias("cs"), F.col("part").alias("ps"), F.explode(F.array(klass - 1, klass, klass + 1)).alias("k"))
    inside = named.select("h", "sid", "n", "component", "part", klass.alias("k"))
    near = 100 * F.least("n", "ns") >= percent * F.greatest("n", "ns")
    met = inside.join(outside, ["h", "k"]).where((F.col("component") != F.col("cs")) & (F.col("part") != F.col("ps")) & near)
    return met.select(F.least("s", "sid").alias("a"), F.greatest("s", "sid").alias("b")).distinct()


def _part_pairs(pairs: DataFrame, homes: DataFrame) -> DataFrame:
    one, two = (homes.select(F.col("id").alias(e), F.col("part").alias(f"p{e}")) for e in "ab")
    return pairs.join(one, "a").join(two, "b").where("pa <> pb").select("a", "b")


def set_components(docs: DataFrame, sets: DataFrame, percent: int = PERCENT, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``id, component`` of the sets that are linked with another one; ``docs(key, _text)``, ``sets(key, n, sid)``."""
    frequent = frequent_shingles(docs, percent, hot)
    rows = _candidates(_postings(docs, frequent, percent), percent, hot)
    # one row per pair and list; pairs are combined before the shuffle
    met = materialize(rows.groupBy("a", "b", F.when(F.col("need") < 0, F.col("c")).alias("n")).agg(F.sum("c").alias("c"), F.max("need").alias("need")))
    members = met.where("n is not null").select(F.col("a").alias("h"), F.col("b").alias("sid"), "n")
    pairs = materialize(met.where("n is null and c >= need").select("a", "b"))
    clusters = materialize(components(pairs).withColumnRenamed("component", "cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    placed = materialize(clusters.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))))
    keys = sets.groupBy("sid").agg(F.min("key").alias("key"))
    wanted = keys.join(placed, F.col("sid") == F.col("id")).select("key", "sid", "cluster", "part")

    def shingles(batches) -> Iterator[pa.RecordBatch]:
        for part, values, at in _sets(batches):
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
            # sorted as signed numbers, as later readers see them
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("sid", "cluster", "part")] + [lists], names=["sid", "cluster", "part", "shingles"])

    texts = docs.join(wanted, "key").select("key", "_text", "sid", "cluster", "part").dropDuplicates(["key"])
    full = materialize(texts.mapInArrow(shingles, "sid long, cluster long, part long, shingles array<long>").withColumn("shingles", F.array_sort("shingles")))
    links = materialize(_tree_links(full, percent))
    comps = components(links)
    homes = placed.where("parts > 1").select("id", "part")
    if homes.isEmpty():  # no cluster was split: every candidate pair has been judged
        return comps
    # pairs between the parts of a split cluster: those met so far join the large groups, so that few members of a hot
    # list are outside its largest group when all that is left of the list is met
    links, comps = _joined(materialize(_part_pairs(pairs, homes)), links, comps, full, percent)
    return _joined(materialize(_hot_pairs(members, homes, comps, percent)), links, comps, full, percent)[1]


def _joined(open_pairs: DataFrame, links: DataFrame, comps: DataFrame, full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links and components with those of ``open_pairs``: first one for two groups, then more, then all that are left."""
    for most in STEPS:
        left = _with_components(open_pairs, comps)
        if most:
            groups = [F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"), F.pmod(F.xxhash64("a", "b"), F.lit(most)).alias("k")]
            left = left.groupBy(*groups).agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")
        left = materialize(left)
        if left.isEmpty():
            break
        more = materialize(_verified(left, full, percent))
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = materialize(components(links))
    return links, comps


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = with_whole_rows(docs, F.col(f"`{id_col}`").alias("doc_id"), text.alias("_text"))
    return rows.withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("_text")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, group`` per row of ``docs``; ``key`` stands for id and text, ``group`` for
    the component, also where no row of it has an id.

    NULL, empty and blank texts have no shingles and are linked with nothing: their component is their own id.
    Texts of fewer than five words have one shingle. Rows with NULL ids take part; a component of only such rows
    has a NULL id. Repeated rows get equal results; an empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    slim = keyed.select("key", "_text")
    sets = materialize(light_sets(slim)).dropDuplicates(["key"])
    comps = set_components(slim, sets.where("n > 0"), percent, hot, block)
    ids = materialize(keyed.select("doc_id", "key").join(sets, "key"))
    return _labelled(ids, comps)


def _labelled(ids: DataFrame, comps: DataFrame) -> DataFrame:
    node = ids.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("_low"))
    node = node.join(comps, F.col("sid") == F.col("id"), "left").withColumn("_c", F.coalesce("component", "sid"))
    lowest = node.groupBy("_c").agg(F.min("_low").alias("_first"))
    named = materialize(node.join(lowest, "_c").select(F.col("sid").alias("_sid"), "_first", "_c"))
    met = ids.join(named, F.col("sid") == F.col("_sid"), "left")
    return met.select(*[c for c in ids.columns if c not in ("n", "sid")], F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_first")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("_c", "key").alias("group"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Contract form: ``doc_id, n_shingles, component_id``."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return near_duplicates(slim, "doc_id", "text", percent, hot, block).select("doc_id", "n_shingles", "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The row with the smallest id of every component, with all its columns; of equal or NULL ids the first by text key."""
    rows = near_duplicates(docs, id_col, text_col, percent)
    kept = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = materialize(kept.groupBy("group").agg(F.min("key").alias("key")).select("key").distinct())
    met = _keyed(docs, id_col, text_col).select("_row", "key").join(keys, "key", "left_semi")
    return met.dropDuplicates(["key"]).select("_row.*")


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id"""
