"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes the usual disguises: capitals, accents, look-alike letters of other scripts, digits and signs that
stand for letters, invisible characters. The lexicon is a short fixed list plus words and word beginnings that the
labels single out. Matches inside an exception phrase do not count. The sum of weights, also per length, gives a
probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelens.llm.common import fold_of, mix, row_sets, utf8
from tablelens.session import materialize

SAMPLE = 3000  # labelled rows per class at most: the bound of what is learned from
STEMS = (4, 5, 6)
EVIDENCE = 25.0  # log likelihood ratio that a learned entry needs
THRESHOLD = 0.5

# fixed values: words of abuse, the phrases in which they are harmless, look-alikes
WORDS = "idiot moron stupid loser scum trash clown pathetic disgusting worthless imbecile dumbass bastard retard pervert vermin filth degenerate".split()
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash day", "trash collection", "class clown", "clown fish", "circus clown",
    "pond scum", "soap scum", "sore loser", "loser bracket", "winner or loser", "white trash bag",
)
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "i", "ø": "o", "đ": "d",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}


def _folding() -> dict[int, str | None]:
    """Single letters only; l and i are one letter, as 1 stands for both. Everything that is no letter is a blank."""
    out: dict[int, str | None] = {c: " " for c in range(0x80) if not chr(c).isalnum()}
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(c).lower())[0]
        if base.isascii() and base.isalpha():
            out[c] = base
    for c in range(0x2000, 0x2070):
        out[c] = " "
    for c in (*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
        out[c] = None
    for c in range(0xFF01, 0xFF5F):
        out[c] = chr(c - 0xFEE0).lower() if chr(c - 0xFEE0).isalnum() else " "
    out |= {ord(a): b for a, b in (LOOKALIKES | DIGITS).items()}
    return {c: "i" if x == "l" else x for c, x in out.items()} | {ord("l"): "i"}


_FOLD = _folding()
_SIGN = re.compile(r"[@$!](?=[A-Za-z])")


def fold(text: str) -> str:
    """Folded text between blanks."""
    text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    return " " + text.lower().translate(_FOLD) + " "


def _outside(hits: list[tuple], spared: list[tuple]) -> list[tuple]:
    """Hits that lie in no exception; both are ordered by their ends, and one pass meets them."""
    first = [begin for begin, _, _ in spared]
    for i in range(len(first) - 2, -1, -1):
        first[i] = min(first[i], first[i + 1])  # the first begin of the exceptions that end here or later
    out, i = [], 0
    for hit in hits:
        while i < len(spared) and spared[i][1] < hit[1]:
            i += 1
        if i == len(spared) or first[i] > hit[0]:
            out.append(hit)
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]  # " word " or " stem"
    exceptions: list[str]
    slope: tuple[float, float, float] = (-4.0, 3.0, 0.5)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "slope": self.slope, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                made.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                made.add_word(phrase, (len(phrase), None))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float]:
        """Logs of the weight found, and of the weight per hundred words."""
        if not text:
            return 0.0, 0.0
        folded = fold(text)
        hits, spared = [], []
        for end, (size, weight) in self.automaton().iter(folded):
            (spared if weight is None else hits).append((end - size + 1, end, weight))
        if spared:
            hits = _outside(hits, spared)
        total = sum(w for _, _, w in hits)
        words = max(1, folded.count(" ") - 1)
        return float(np.log1p(total)), float(np.log1p(100 * total / words))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        return float(1 / (1 + np.exp(-(self.slope[0] + self.slope[1] * a + self.slope[2] * b))))


def terms_of(folded: str) -> set[str]:
    """Whole words " w " and word beginnings " w", of four letters at least."""
    out = set()
    for word in set(folded.split()):
        if len(word) >= STEMS[0] and word.isalpha():
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in STEMS if n < len(word))
    return out


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``_text, _y`` of at most about ``SAMPLE`` labelled rows per class by id hash; near copies are left out.

    Of rows that share the least of their five-word shingles (three hash orders) one is taken, so that words which
    many copies of one text share do not look like evidence.
    """
    marked = labels.where(fold_of(f"`{id_col}`") != 0).where(F.col(f"`{label_col}`").isin(0, 1))
    marked = marked.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_y"))
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    hashed = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 40))
    bound = F.coalesce(*[F.when(F.col("_y") == y, F.lit(int(min(1.0, SAMPLE / n) * (1 << 40)))) for y, n in counts.items()])
    # of labels that contradict each other the lower one counts
    picked = marked.where(hashed < bound).groupBy("_id").agg(F.min("_y").alias("_y"))
    # the picked ids are bounded by the sample size, so the texts need no shuffle
    texts = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_text", F.col("_y").cast("int").alias("_y"))

    def least(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = row_sets(*utf8(batch.column(0)))
            orders = []
            for k in range(3):
                mixed = mix(values ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))).view(np.int64)
                orders.append([int(mixed[a:b].min()) if a < b else None for a, b in zip(at[:-1], at[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(o, pa.int64()) for o in orders]], names=["_text", "_y", "_m0", "_m1", "_m2"])

    marked = rows.mapInArrow(least, "_text string, _y int, _m0 long, _m1 long, _m2 long").where("_m0 is not null")
    # the first by text, so that a repeated run takes the same
    for k in range(3):
        marked = marked.groupBy(f"_m{k}", "_y").agg(F.min(F.struct("_text", *[f"_m{i}" for i in range(3) if i != k])).alias("_s"))
        marked = marked.select("_y", f"_m{k}", "_s.*")
    return materialize(marked.select("_text", "_y"))


def _counted(sample: DataFrame) -> DataFrame:
    """Documents with each term, by label."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in terms_of(fold(text)):
                    found.setdefault(t, [0, 0])[y] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([x[0] for x in found.values()]), pa.array([x[1] for x in found.values()])], names=["term", "n0", "n1"])

    rows = sample.mapInArrow(run, "term string, n0 long, n1 long")
    return rows.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _chosen(rows: list, n0: int, n1: int) -> dict[str, float]:
    """Entries by evidence; of nested ones, the longest that has (nearly) all the evidence, else the shorter."""
    begun: dict[str, int] = {}  # the beginnings of what is kept, with its largest n1, which comes first
    weights: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (-r["n1"], -len(r["term"]), r["term"])):
        term = r["term"]
        beginnings = [term[:n] for n in range(1, len(term) + 1)]
        if any(x in weights for x in beginnings) or r["n1"] <= 1.1 * begun.get(term, -1):
            continue
        for x in beginnings:
            begun.setdefault(x, r["n1"])
        odds = np.log((r["n1"] + 0.5) / (n1 + 1)) - np.log((r["n0"] + 0.5) / (n0 + 1))
        weights[term] = float(np.clip(odds, 1.0, 5.0))
    return weights


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """The fixed list with weight 3, entries learned from a bounded sample, and a logistic curve over both features."""
    lexicon = Lexicon({f" {w.translate(_FOLD)} ": 3.0 for w in WORDS}, [f" {p.translate(_FOLD)} " for p in EXCEPTIONS])
    sample = _sample(docs, labels, id_col, text_col, label_col)
    if sample is None:
        return lexicon
    counts = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return lexicon
    base = n1 / (n0 + n1)
    a, b = F.col("n1"), F.col("n0")
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((a + b) * p))).otherwise(0.0)
    ratio = 2 * (part(a, base) + part(b, 1 - base))
    counted = materialize(_counted(sample))
    strong = counted.where((a > 4 * base * (a + b) / (1 + 3 * base)) & (ratio >= EVIDENCE))
    lexicon.weights |= _chosen(strong.collect(), n0, n1)  # no more than the terms of the bounded sample
    found = _features(sample, lexicon)
    lexicon.slope = _curve(np.array([[r["a"], r["b"]] for r in found]), np.array([r["_y"] for r in found]))
    return lexicon


def _features(sample: DataFrame, lexicon: Lexicon) -> list:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x for x, _ in got], pa.float64()), pa.array([y for _, y in got], pa.float64())], names=["_y", "a", "b"])

    return sample.mapInArrow(run, "_y int, a double, b double").collect()


def _curve(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression with non-negative slopes; both classes weigh the same."""
    full = np.column_stack((np.ones(len(x)), x))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta = np.array([-2.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ beta))
        slope = full.T @ (weight * (p - y)) + penalty * np.array([0, beta[1], beta[2]])
        bend = (full * (weight * p * (1 - p))[:, None]).T @ full + np.diag([1e-6, penalty, penalty])
        beta = beta - np.linalg.solve(bend, slope)
        beta[1:] = np.maximum(beta[1:], 0.0)
    return tuple(float(v) for v in beta)


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    NULL and empty texts have no match and the lowest score. Labels other than 0 and 1 and NULL ids teach nothing;
    without labels the fixed list and a fixed curve are used. Every row is scored by itself, so repeated rows give
    rows of their own; an empty table gives no rows.
    """
    lexicon = learn(docs, labels, id_col, text_col, label_col)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold_of(f"`{id_col}`") == 0).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [lexicon.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
