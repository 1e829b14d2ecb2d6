"""Quality classifier: a byte-level convolutional network in numpy.

The text is cut into overlapping chunks that cover all of it. Filters over ``TAPS`` bytes slide over each chunk;
their maxima give the chunk a logit, and the length-weighted mean of the logits gives one probability. A filter
is a table of one weight per tap and byte, so it is learned directly on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelens.llm.common import fold_of, shards

CHUNK, STEP = 1024, 960  # bytes; neighbours share 64
TAPS, FILTERS = 8, 16
SAMPLE = 2500  # labelled rows per class at most: the bound of what is learned from
EPOCHS, BATCH, RATE = 6, 64, 0.01
SLICE = 1024  # chunks whose bytes are laid out at once; a multiple of the 64 that are scored together
THRESHOLD = 0.3
_EMPTY = b" "


def chunk_slices(data: np.ndarray, at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of all rows, filled up with blanks: ``(chunks, row, bytes)``, at most ``limit`` at once; an empty row has
    one blank chunk."""
    sizes = np.diff(at)
    counts = np.maximum(1, -(-np.maximum(sizes - (CHUNK - STEP), 0) // STEP))
    rows = np.repeat(np.arange(len(sizes)), counts)
    begins = at[:-1][rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    padded = data if len(data) else np.frombuffer(_EMPTY, np.uint8)
    for k in range(0, len(rows), limit):
        row, begin = rows[k : k + limit], begins[k : k + limit]
        length = np.minimum(CHUNK, at[1:][row] - begin)
        place = np.minimum(begin[:, None] + np.arange(CHUNK), len(padded) - 1)
        inside = np.arange(CHUNK) < length[:, None]
        yield np.where(inside, padded[place], 0x20).astype(np.uint8), row, np.maximum(length, 1)


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.taps = (rng.standard_normal((TAPS, 256, FILTERS)) * 0.1).astype(np.float32)
        self.out = (rng.standard_normal(FILTERS) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.shift = np.zeros(1, np.float32)
        self.pairs: np.ndarray | None = None

    def activations(self, chunks: np.ndarray) -> np.ndarray:
        """Filter values at every place: ``(chunk, place, filter)``. Two taps are one table of byte pairs."""
        if self.pairs is None:
            self.pairs = (self.taps[0::2, :, None, :] + self.taps[1::2, None, :, :]).reshape(TAPS // 2, 65536, FILTERS)
        pair = chunks[:, :-1].astype(np.int32) * 256 + chunks[:, 1:]
        places = CHUNK - TAPS + 1
        total = self.pairs[0][pair[:, :places]]
        for k in range(1, TAPS // 2):
            total += self.pairs[k][pair[:, 2 * k : 2 * k + places]]
        return total

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        out = [np.maximum(self.activations(chunks[i : i + 64]).max(axis=1) + self.bias, 0) @ self.out + self.shift for i in range(0, len(chunks), 64)]
        return np.concatenate(out) if out else np.zeros(0)

    def fit(self, chunks: np.ndarray, labels: np.ndarray, seed: int = 0) -> None:
        """Adam on the cross entropy of single chunks."""
        rng = np.random.default_rng(seed)
        params = [self.taps, self.out, self.bias, self.shift]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(chunks))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                x, y = chunks[pick], labels[pick].astype(np.float32)
                self.pairs = None
                values = self.activations_single(x)
                place = values.argmax(axis=1)
                top = np.take_along_axis(values, place[:, None, :], 1)[:, 0] + self.bias
                hidden = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift, -30, 30)))
                error = (p - y) / len(pick)
                back = error[:, None] * self.out * (top > 0)
                slope = np.zeros_like(self.taps)
                rows, filters = np.arange(len(pick))[:, None], np.arange(FILTERS)[None, :]
                for t in range(TAPS):
                    np.add.at(slope[t], (x[rows, place + t], np.broadcast_to(filters, place.shape)), back)
                slopes = [slope, hidden.T @ error, back.sum(0), np.array([error.sum()], np.float32)]
                step += 1
                for p_, g, m, v in zip(params, slopes, first, second):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.pairs = None

    def activations_single(self, x: np.ndarray) -> np.ndarray:
        places = CHUNK - TAPS + 1
        total = self.taps[0][x[:, :places]]
        for t in range(1, TAPS):
            total += self.taps[t][x[:, t : t + places]]
        return total

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One probability per row."""
        parts = [(self.logits(chunks).astype(np.float64), row, size) for chunks, row, size in chunk_slices(data, at)]
        if not parts:
            return np.zeros(0)
        logit, row, size = (np.concatenate(x) for x in zip(*parts))
        mean = np.bincount(row, logit * size, len(at) - 1) / np.bincount(row, size, len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[Network | None, float]:
    """A network from at most ``SAMPLE`` labelled rows per class of the training folds, and the share of label 1.

    Rows are picked by id hash. Of each, two chunks at places given by the hash are learned from.
    """
    marked = labels.where(fold_of(f"`{id_col}`") != 0).where(F.col(f"`{label_col}`").isin(0, 1))
    marked = marked.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_y"))
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None, 0.5
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    hashed = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 40))
    bound = F.coalesce(*[F.when(F.col("_y") == y, F.lit(int(min(1.0, SAMPLE / n) * (1 << 40)))) for y, n in counts.items()])
    # of labels that contradict each other the lower one counts
    picked = marked.where(hashed < bound).groupBy("_id").agg(F.min("_y").alias("_y")).withColumn("_h", hashed)
    # the picked ids are bounded by the sample size, so the texts need no shuffle
    texts = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    data = F.encode("_text", "utf-8")
    places = [F.pmod(F.col("_h") if k == 0 else F.shiftright("_h", 16), F.greatest(F.length("_data") - CHUNK, F.lit(0)) + 1) for k in range(2)]
    rows = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_y", "_h", data.alias("_data"))
    rows = rows.select("_y", "_h", *[F.substring("_data", (p + 1).cast("int"), F.lit(CHUNK)).alias(f"_c{k}") for k, p in enumerate(places)])
    got = sorted(rows.collect(), key=lambda r: (r["_h"], r["_y"], bytes(r["_c0"])))
    if not got:
        return None, share
    pieces = [bytes(r[f"_c{k}"]).ljust(CHUNK) for r in got for k in range(2)]
    chunks = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, CHUNK)
    network = Network()
    network.fit(chunks, np.repeat([r["_y"] for r in got], 2))
    sampled = sum(r["_y"] for r in got)
    # the sample holds the classes about evenly: put back how common they are
    odds = np.log(share / (1 - share)) - np.log((sampled + 0.5) / (len(got) - sampled + 0.5))
    network.shift += np.float32(odds)
    return network, share


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    NULL counts as the empty text, which is scored as one blank chunk. Labels other than 0 and 1 and NULL ids teach
    nothing; without labels every score is 0.5. Every row is scored by itself, repeated rows alike; an empty table
    gives no rows. A very long text is laid out ``SLICE`` chunks at a time.
    """
    network, _ = learn(docs, labels, id_col, text_col, label_col)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold_of(f"`{id_col}`") == 0).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in shards(batch, batch.column(2)):
                score = network.scores(data, at) if network else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    scored = slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
