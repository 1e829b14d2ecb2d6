"""Phrase collocations by partitioned mining (SON).

The documents are dealt into a few shards. A phrase with ``support`` occurrences in its language has at least its
share of them in some shard, so every shard is mined completely at a support lowered to its share of the words, the
locally frequent phrases are united, and all of them are counted in all documents.

* A shard is not what one task holds but a hash class of documents, and is mined by all tasks together: with an
  absolute support, more shards than that would make every phrase locally frequent.
* Mining goes by length: words that are frequent in their language, pairs of them, then triples and quadruples all
  of whose pairs are frequent in the shard.
* What is frequent goes to the next pass as a bitmap of hashes, whose size has a fixed limit. A bitmap only leaves
  out work: whatever it lets through is counted, by its words at the end, and held against the full support.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelens.llm.common import class_table, mix, shards, windows, words_of
from tablelens.operators.joins import join_stats, top_k
from tablelens.session import materialize

SUPPORT = 30
SHARDS = 8  # at most 16; the local support of an even shard is support / SHARDS
LONGEST = 4
TOP = 2000
INSIDE = 80  # per cent of a phrase's occurrences inside one longer phrase that make it a mere part of that
BITS = (16, 29)  # smallest and largest bitmap: 64 MB at most
BLOCK = 1 << 20  # occurrences combined at once in a task
KEPT = 250_000  # phrases that a task counts before it hands them on

BLANK = [0x20, 0x09]
BREAK = [*b".,;:!?", *range(0x0A, 0x0E)]
WORD = class_table(lambda b: b not in BLANK and b not in BREAK)
_BREAK = class_table(lambda b: b in BREAK)


@lru_cache(maxsize=4096)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Bitmap:
    """A set of 64-bit keys as bits at their leading digits; says yes to every member and to some others."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data


    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def bitmap_of(keys: DataFrame, key: Column, limits: tuple[int, int] = BITS) -> Bitmap:
    """Bitmap with about sixteen bits a key as long as the limit allows; built by Spark, at most 64 MB arrive here."""
    bits = min(max(limits[0], (16 * keys.count()).bit_length()), limits[1])
    place = F.shiftrightunsigned(key, 64 - bits) + 1
    parts = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    data = np.zeros(max(1 << bits, 1 << 15) >> 3, np.uint8)
    for b, m in parts.toLocalIterator():
        data[(b - 1) << 12 : b << 12] = np.frombuffer(m, np.uint8)
    return Bitmap(bits, data)


class Words:
    """The words of some documents: places, keys and pieces."""

    def __init__(self, part: pa.RecordBatch, data: np.ndarray, at: np.ndarray):
        self.data = data
        self.start, self.end, self.hash = words_of(data, at, WORD)
        self.row = np.searchsorted(at, self.start, side="right") - 1
        # breaks and rows only go up, so their sum tells pieces apart
        self.piece = np.cumsum(_BREAK[data], dtype=np.int32)[self.start] + self.row if len(self.start) else self.row
        langs = part.column("lang").to_pylist()
        self.salt = np.array([_salt(x) for x in langs], np.uint64)[self.row]
        self.shard = part.column("shard").to_numpy().astype(np.uint64)[self.row]
        self.support = part.column("support").to_numpy()[self.row]

    def keys(self, size: int) -> np.ndarray:
        """Key of the ``size`` words from each position on, also where they leave their piece."""
        code = self.hash if size == 1 else windows(self.hash, size)
        return mix(code ^ (self.salt[: len(code)] + np.uint64(size)))

    def whole(self, size: int) -> np.ndarray:
        """Positions from which ``size`` words stand in one piece."""
        n = max(0, len(self.piece) - size + 1)
        return self.piece[:n] == self.piece[size - 1 :][:n]

    def phrase(self, at: int, size: int) -> bytes:
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(at, at + size)).lower()


def _of_shard(keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return keys ^ (shard[: len(keys)] << np.uint64(60))


def _all_of(flags: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` flags from each position on are set."""
    n = max(0, len(flags) - size + 1)
    out = np.ones(n, bool)
    for k in range(size):
        out &= flags[k : k + n]
    return out


def _read(batches) -> Iterator[Words]:
    for batch in batches:
        for part, data, at in shards(batch, batch.column("text")):
            yield Words(part, data, at)


def _summed(found: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of equal keys ``(key, shard, support)`` with their counts."""
    held, n = [], 0

    def block():
        key, shard, support = (np.concatenate(x) for x in zip(*held))
        _, first, counts = np.unique(_of_shard(key, shard), return_index=True, return_counts=True)
        cols = [key[first].view(np.int64), shard[first].astype(np.int32), support[first].astype(np.int64), counts]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    for item in found:
        held.append(item)
        n += len(item[0])
        if n >= BLOCK:
            yield block()
            held, n = [], 0
    if n:
        yield block()


_COUNTED = "k long, shard int, support long, c long"
_NAMES = ["k", "shard", "support", "c"]


def _prepared(docs: DataFrame, id_col: str, text_col: str, lang_col: str, n_shards: int) -> DataFrame:
    row_id, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.pmod(F.xxhash64(row_id, text), F.lit(n_shards)).cast("int").alias("shard"), text.alias("text"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """Pass 1: ``k, c`` per word of a language, and ``lang, shard, c`` totals with no key."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, n, totals = [], 0, {}

        def block():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            none = pa.nulls(len(keys), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), none, pa.nulls(len(keys), pa.int32()), pa.array(counts)], names=["k", "lang", "shard", "c"])

        for batch in batches:
            batch = batch.append_column("support", pa.array(np.zeros(batch.num_rows, np.int64)))
            for part, data, at in shards(batch, batch.column("text")):
                words = Words(part, data, at)
                held.append(words.keys(1))
                n += len(held[-1])
                for lang, shard, c in zip(part.column("lang").to_pylist(), part.column("shard").to_pylist(), np.bincount(words.row, minlength=part.num_rows).tolist()):
                    totals[lang, shard] = totals.get((lang, shard), 0) + c
                if n >= BLOCK:
                    yield block()
                    held, n = [], 0
            if len(totals) > KEPT:
                yield _total_rows(totals)
                totals = {}
        if n:
            yield block()
        if totals:
            yield _total_rows(totals)

    return rows.mapInArrow(run, "k long, lang string, shard int, c long").groupBy("k", "lang", "shard").agg(F.sum("c").alias("c"))


def _total_rows(totals: dict) -> pa.RecordBatch:
    langs, shard = zip(*totals)
    return pa.RecordBatch.from_arrays([pa.nulls(len(langs), pa.int64()), pa.array(langs, pa.string()), pa.array(shard, pa.int32()), pa.array(list(totals.values()), pa.int64())], names=["k", "lang", "shard", "c"])


def _locally_frequent(found: DataFrame) -> DataFrame:
    """Keys whose count in their shard reaches the local support."""
    sums = found.groupBy("k", "shard").agg(F.sum("c").alias("c"), F.max("support").alias("support"))
    return materialize(sums.where("c >= support").select("k", "shard"))


def _shard_key() -> Column:
    return F.col("k").bitwiseXOR(F.shiftleft(F.col("shard").cast("long"), 60))


def _pairs(rows: DataFrame, single) -> DataFrame:
    """Pass 2: pairs of frequent words per shard."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        def found():
            for words in _read(batches):
                at = np.flatnonzero(words.whole(2) & _all_of(single.value.has(words.keys(1)), 2))
                yield words.keys(2)[at], words.shard[at], words.support[at]

        yield from _summed(found(), _NAMES)

    return rows.mapInArrow(run, _COUNTED)


def _longer(rows: DataFrame, pair, longest: int) -> DataFrame:
    """Pass 3: longer phrases all of whose pairs are frequent in the shard."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        def found():
            for words in _read(batches):
                paired = pair.value.has(_of_shard(words.keys(2), words.shard)) & words.whole(2)
                for size in range(3, longest + 1):
                    at = np.flatnonzero(words.whole(size) & _all_of(paired, size - 1))
                    yield words.keys(size)[at], words.shard[at], words.support[at]

        yield from _summed(found(), _NAMES)

    return rows.mapInArrow(run, _COUNTED)


class _Tally:
    """Counts of phrases by key; the words of a phrase are read where it is first seen."""

    def __init__(self):
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts, self.langs, self.sizes, self.phrases = np.zeros(0, np.int64), [], [], []

    def add(self, words: Words, langs: list[str], size: int, at: np.ndarray) -> None:
        keys, first, counts = np.unique(words.keys(size)[at], return_index=True, return_counts=True)
        if not len(keys):
            return
        where = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        inside = where < len(self.keys)
        fresh[inside] = self.keys[where[inside]] != keys[inside]
        np.add.at(self.counts, self.place[where[~fresh]], counts[~fresh])
        seen_at = at[first[fresh]]
        self.phrases += [words.phrase(i, size) for i in seen_at.tolist()]
        self.langs += [langs[r] for r in words.row[seen_at].tolist()]
        self.sizes += [size] * len(seen_at)
        number = np.arange(len(self.counts), len(self.counts) + len(seen_at))
        self.counts = np.concatenate((self.counts, counts[fresh]))
        self.place = np.insert(self.place, where[fresh], number)
        self.keys = np.insert(self.keys, where[fresh], keys[fresh])

    def batch(self) -> pa.RecordBatch:
        text = pa.array(self.phrases, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(self.langs, pa.string()), pa.array(self.sizes, pa.int32()), text, pa.array(self.counts)], names=["lang", "size", "phrase", "c"])


def _all_counts(rows: DataFrame, single, several, longest: int) -> DataFrame:
    """Pass 4: every occurrence of frequent words and of locally frequent phrases, by their words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for part, data, at in shards(batch, batch.column("text")):
                words, langs = Words(part, data, at), part.column("lang").to_pylist()
                for size in range(1, longest + 1):
                    known = single if size == 1 else several
                    tally.add(words, langs, size, np.flatnonzero(words.whole(size) & known.value.has(words.keys(size))))
                if len(tally.keys) >= KEPT:
                    yield tally.batch()
                    tally = _Tally()
        if len(tally.keys):
            yield tally.batch()

    return rows.mapInArrow(run, "lang string, size int, phrase string, c long").groupBy("lang", "size", "phrase").agg(F.sum("c").alias("f"))


def frequent_phrases(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    support: int = SUPPORT, longest: int = LONGEST, n_shards: int = SHARDS, bits: tuple[int, int] = BITS,
) -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, f`` of all words and phrases with ``support`` occurrences, and ``lang, n`` totals."""
    rows = _prepared(docs, id_col, text_col, lang_col, n_shards)
    send = docs.sparkSession.sparkContext.broadcast
    first = materialize(_word_counts(rows).where((F.col("c") >= support) | F.col("k").isNull()))
    single = send(bitmap_of(first.where("k is not null"), F.col("k"), bits))
    per_shard = first.where("k is null").select("lang", "shard", "c")
    totals = materialize(per_shard.groupBy("lang").agg(F.sum("c").alias("n")))
    # the least whole number that is not below support * words of the shard / words of the language
    share = F.expr(f"(cast(c AS decimal(20,0)) * {support} + n - 1) div n").cast("long")
    lowered = per_shard.join(totals, "lang").where("n > 0").select("lang", "shard", F.greatest(share, F.lit(1)).alias("support"))
    # texts without words have no share and nothing to count
    dealt = join_stats(rows, lowered, ["lang", "shard"]).withColumn("support", F.coalesce("support", F.lit(support)))
    pairs = _locally_frequent(_pairs(dealt, single))
    pair = send(bitmap_of(pairs, _shard_key(), bits))
    united = pairs.unionByName(_locally_frequent(_longer(dealt, pair, longest))).select("k").distinct() if longest > 2 else pairs.select("k").distinct()
    several = send(bitmap_of(united, F.col("k"), bits))
    counted = _all_counts(dealt, single, several, longest)
    return materialize(counted.where(F.col("f") >= support)), totals


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT,
    longest: int = LONGEST, top: int = TOP, n_shards: int = SHARDS, bits: tuple[int, int] = BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language.

    A phrase has 2 to ``longest`` words of one piece of a text and ``support`` occurrences; its score is that of its
    weakest cut in two. Phrases most of whose occurrences lie in one longer phrase are left out. A NULL text has no
    words and counts for nothing, as an empty one; a NULL language is ``und``; ids only deal documents into shards,
    so NULL or repeated ids and repeated rows count like others. Very long texts are read piece by piece of the
    batch and may hold any number of words; an empty table gives an empty result; further columns are not read.
    Equal scores go by ``a``, then by the phrase. Keys of 64 bits stand for phrases inside one task; across tasks
    phrases are counted by their words.
    """
    freq, totals = frequent_phrases(docs, id_col, text_col, lang_col, support, longest, n_shards, bits)
    phrases = freq.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("size")).alias("rest"))
    left = freq.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = freq.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + r)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    # phrases inside longer ones
    inner = phrases.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    around = inner.select("lang", _part(F.col("from"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = weakest.join(around, ["lang", "phrase"], "left")
    kept = kept.where(F.expr(f"around IS NULL OR cast(around AS decimal(20,0)) * 100 < cast(a AS decimal(20,0)) * {INSIDE}"))
    named = kept.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("w.score").alias("score"))
    ranked = top_k(named, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
spans AS (SELECT lang, words, unnest(range(1, {LONGEST} + 1)) AS size FROM w),
starts AS (SELECT lang, size, words, unnest(range(1, len(words) - size + 2)) AS pos FROM spans WHERE size <= len(words)),
freq AS (
  SELECT lang, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= {SUPPORT}),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM freq WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
parts AS (SELECT lang, phrase, a, k, array_to_string(list_slice(words, 1, k), ' ') AS p, array_to_string(list_slice(words, k + 1, size), ' ') AS q FROM cuts),
scored AS (
  SELECT parts.lang, parts.phrase, a, k, x.f AS l, y.f AS r, ((a::HUGEINT * 2000000) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM parts JOIN freq x ON x.lang = parts.lang AND x.phrase = p JOIN freq y ON y.lang = parts.lang AND y.phrase = q),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, a, words, size, unnest(range(2, size)) AS m FROM cand WHERE size > 2),
subs AS (SELECT lang, a, words, m, unnest(range(1, size - m + 2)) AS pos FROM sub),
around AS (SELECT lang, array_to_string(list_slice(words, pos, pos + m - 1), ' ') AS phrase, max(a) AS f FROM subs GROUP BY ALL),
kept AS (
  SELECT weakest.* FROM weakest LEFT JOIN around ON around.lang = weakest.lang AND around.phrase = weakest.phrase
  WHERE around.f IS NULL OR around.f::HUGEINT * 100 < a::HUGEINT * {INSIDE}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= {TOP}
"""
