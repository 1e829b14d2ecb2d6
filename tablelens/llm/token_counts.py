"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

The text of a huge document is cut into chunks that overlap. Two neighbouring encodings are joined at a byte
position where both have a token boundary and where the pre-tokeniser always cuts: before white space that follows
something else. A match of its pattern begins afresh there whatever came before, so the two encodings agree from
there on. Where the overlap has no such position it is doubled, in the end up to the whole text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablelens.llm.common import utf8
from tablelens.session import materialize

CHUNK = 32_768  # characters of a chunk; longer texts are huge
OVERLAP = 512
LIMIT = 512
MARGIN = 64  # bytes
BATCH_BYTES = 2 << 20
# fixed value: how this vocabulary file cuts text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed values: bytes that the byte-level alphabet writes as themselves
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _alphabet() -> dict[str, int]:
    out = {chr(b): b for b in _PRINTABLE}
    others = [b for b in range(256) if b not in set(_PRINTABLE)]
    return out | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """``(encode, lengths)``: token ids of a list of texts, and the bytes of each id (None: not byte-level).

    A byte-level BPE file whose merges give ascending ids is the same as a rank table, which is encoded with the
    faster library. Any other ``.json`` is left to its own library, and a ``.model`` to sentencepiece.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: model.encode(texts, num_threads=1)), None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _is_rank_table(spec):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        plain.no_truncation()
        plain.no_padding()
        return (lambda texts: [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]), None
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = _alphabet()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    table = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    for token, i in special.items():
        lengths[i] = len(token.encode())
    return (lambda texts: [table.encode(t, allowed_special="all") for t in texts]), lengths


def _is_rank_table(spec: dict) -> bool:
    """Byte-level BPE with the plain pattern, no normaliser and no options, whose n-th merge makes the n-th id."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token"))
    if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) or len(t["content"].encode()) >= MARGIN for t in spec["added_tokens"]):
        return False
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))


def _counts(texts: list[str], encode) -> list[int]:
    return [len(ids) for ids in encode(texts)]


def _stable(data: bytes, ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """Token ends in ``[low, high)`` that stand before ASCII white space and after another character."""
    at = ends[(ends >= max(low, 1)) & (ends < min(high, len(data)))]
    raw = np.frombuffer(data, np.uint8)
    blank = np.zeros(256, bool)
    blank[[0x20, 0x09, 0x0A, 0x0D]] = True
    # the byte before is ASCII and visible, so it is a whole character that is no white space
    before = raw[at - 1]
    return at[blank[raw[at]] & (before > 0x20) & (before < 0x7F)]


def chunk_summary(text: str, start: int, head: int, tail: int, encode, lengths: np.ndarray) -> dict:
    """Stable boundaries of one chunk in its first ``head`` and last ``tail`` bytes.

    Positions are bytes of the whole text (``start`` is the chunk's first byte); ``cum`` is the number of tokens
    of the chunk before the position. The last ``MARGIN`` bytes of a chunk are left out: what follows can
    change them (a special string has to be shorter).
    """
    data = text.encode()
    ids = np.asarray(encode([text])[0], np.int64)
    ends = np.cumsum(lengths[ids])
    first = _stable(data, ends, 1, head) if head else np.zeros(0, np.int64)
    last = _stable(data, ends, len(data) - tail, len(data) - MARGIN) if tail else np.zeros(0, np.int64)
    cum = lambda x: np.searchsorted(ends, x, side="right")
    return {"head": first + start, "head_cum": cum(first), "tail": last + start, "tail_cum": cum(last), "n": len(ids)}


def _cut(key: str, text: str, chunk: int, overlap: int) -> Iterator[tuple]:
    """Chunk ``i`` holds the characters from ``i * chunk`` up to the end of the overlap with the next one."""
    last = (len(text) - 1) // chunk
    byte = 0
    for i in range(last + 1):
        begin = i * chunk
        size = lambda a, b: len(text[a:b].encode())
        head = size(begin, begin + overlap) if i else 0
        tail = size(begin + chunk, begin + chunk + overlap) if i < last else 0
        yield key, i, last, byte, text[begin : begin + chunk + overlap], head, tail
        byte += size(begin, begin + chunk)


def _chunk_rows(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Encode the chunks of ``huge(_key, _text)``: one row per chunk with its boundaries."""
    columns = "_key string, _chunk int, _last int, _byte long, _part string, _head long, _tail long"
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in columns.split(", ")]

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for row in _cut(key, text.as_py(), chunk, overlap):
                    rows.append(row)
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    parts = huge.select("_key", "_text").mapInArrow(cut, columns)

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(path)
        for batch in batches:
            rows = {n: [] for n in ("head", "head_cum", "tail", "tail_cum", "n")}
            byte, head, tail = (batch.column(n).to_pylist() for n in ("_byte", "_head", "_tail"))
            for i in range(batch.num_rows):
                got = chunk_summary(batch.column("_part")[i].as_py(), byte[i], head[i], tail[i], encode, lengths)
                for n, x in got.items():
                    rows[n].append(x)
            longs = [pa.array(rows[n], pa.list_(pa.int64())) for n in ("head", "head_cum", "tail", "tail_cum")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_chunk"), batch.column("_last"), *longs, pa.array(rows["n"], pa.int64())], names=["_key", "_chunk", "_last", "head", "head_cum", "tail", "tail_cum", "n"])

    spread = parts.repartition("_key", "_chunk")
    return spread.mapInArrow(run, "_key string, _chunk int, _last int, head array<long>, head_cum array<long>, tail array<long>, tail_cum array<long>, n long")


def spliced_counts(huge: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``_key, n_tokens`` of huge texts ``(_key, _text)``, each key once.

    Rounds: texts with a seam that has no common stable boundary go again with twice the overlap; an overlap
    beyond the length of the text leaves chunk 0 as the whole text, which needs no seam.
    """
    todo = huge.select("_key", "_text")
    done = None
    while True:
        rows = materialize(_chunk_rows(todo, path, chunk, overlap))
        order = Window.partitionBy("_key").orderBy("_chunk")
        seams = rows.withColumn("_before", F.lag(F.struct("tail", "tail_cum")).over(order))
        common = F.array_min(F.array_intersect(F.col("_before.tail"), F.col("head")))
        seams = seams.withColumn("_at", F.when(F.col("_chunk") > 0, common))
        # tokens of the chunk before up to the seam, and of this chunk up to the seam
        there = F.element_at(F.col("_before.tail_cum"), F.array_position(F.col("_before.tail"), F.col("_at")).cast("int"))
        here = F.element_at("head_cum", F.array_position("head", F.col("_at")).cast("int"))
        seams = seams.withColumn("_gain", F.when(F.col("_chunk") > 0, there - here))
        sums = seams.groupBy("_key").agg(
            F.count_if((F.col("_chunk") > 0) & F.col("_at").isNull()).alias("_failed"),
            # every chunk but the last is counted up to its seam, from the seam before
            (F.coalesce(F.sum("_gain"), F.lit(0)) + F.max(F.when(F.col("_chunk") == F.col("_last"), F.col("n")))).alias("n_tokens"),
        )
        sums = materialize(sums)
        part = sums.where("_failed = 0").select("_key", "n_tokens")
        done = part if done is None else done.unionByName(part)
        failed = sums.where("_failed > 0").select("_key")
        if failed.isEmpty():
            return done
        overlap *= 2
        again = huge.join(failed, "_key", "left_semi").select("_key", "_text")
        whole = again.where(F.char_length("_text") <= 2 * overlap)
        counted = _whole_counts(whole.select("_key", "_text"), path)
        done = done.unionByName(counted)
        todo = again.where(F.char_length("_text") > 2 * overlap)


def _whole_counts(texts: DataFrame, path: str) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_counts(batch.column(1).to_pylist(), encode), pa.int64())], names=["_key", "n_tokens"])

    return texts.mapInArrow(run, "_key string, n_tokens long")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    NULL counts as the empty text, which has no tokens. Rows with equal texts are counted alike, rows with equal
    ids stay apart; an empty table gives an empty result. ``path`` is the tokenizer file, which must exist at the
    same place on every machine.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    byte_level = encoder(path)[1] is not None

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(path)
        for batch in batches:
            sizes = np.diff(utf8(batch.column(1))[1])
            first = 0
            while first < batch.num_rows:
                upto = np.cumsum(sizes[first:])
                n = max(1, int(np.searchsorted(upto, BATCH_BYTES)))
                part = batch.slice(first, n)
                texts = part.column(1).to_pylist()
                long = [byte_level and len(t) > chunk for t in texts]
                counts = _counts(["" if late else t for t, late in zip(texts, long)], encode)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes[first : first + n]), pa.array([None if late else c for c, late in zip(counts, long)], pa.int64()), pa.array([t if late else None for t, late in zip(texts, long)], pa.string())], names=["doc_id", "n_bytes", "n_tokens", "_huge"])
                first += n

    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, _huge string")
    if byte_level:
        # written once: short texts are done, huge ones (a few in a hundred) come with their text
        counted = materialize(counted.withColumn("_key", F.when(F.col("_huge").isNotNull(), F.sha2("_huge", 256))))
        huge = counted.where("_huge is not null").select("_key", F.col("_huge").alias("_text")).dropDuplicates(["_key"])
        spliced = spliced_counts(huge, path, chunk, overlap).select(F.col("_key").alias("_k"), F.col("n_tokens").alias("_n"))
        late = counted.where("_huge is not null").select("doc_id", "n_bytes", "_key").join(spliced, F.col("_key") == F.col("_k"))
        counted = counted.where("_huge is null").select("doc_id", "n_bytes", "n_tokens").unionByName(late.select("doc_id", "n_bytes", F.col("_n").alias("n_tokens")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
