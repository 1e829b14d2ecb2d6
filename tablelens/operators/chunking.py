"""Documents to chunks of bounded length with a short overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# fixed values: chunk length, overlap, search range for a break
CHUNK_CHARS, OVERLAP_CHARS, BREAK_RANGE = 500, 50, 100


class _Marks:
    """Where a text may be cut: ends of paragraphs, of sentences (after the stop) and of words."""

    def __init__(self, text: str):
        self.text = "\n\n".join(p for p in map(str.strip, re.split(r"\n\n+", text)) if p)
        self.paragraphs = [m.start() for m in re.finditer(r"\n\n+", self.text)] + [len(self.text)]
        self.sentences = [m.start() + 1 for m in re.finditer(r"\. ", self.text)]
        self.words = [m.start() for m in re.finditer(" ", self.text)]

    @staticmethod
    def last(marks: list[int], low: int, high: int) -> int | None:
        """Greatest mark in ``(low, high]``."""
        i = bisect_right(marks, high) - 1
        return marks[i] if i >= 0 and marks[i] > low else None

    def first_start(self, low: int, high: int) -> int:
        """First sentence start in ``[low, high)``, or else word start, or else ``low``."""
        for marks in (self.sentences, self.words):
            i = bisect_left(marks, low + (marks is self.sentences))
            if i < len(marks) and marks[i] + 1 <= high:
                return marks[i] + 1
        return low


def chunk_text(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Pieces of at most ``size`` characters, each a stretch of the text.

    A piece ends after the last paragraph that fits. If none does, it ends after a sentence, a word or at the full
    size, whichever comes first among those within ``BREAK_RANGE`` of the size, and the next piece goes on there.
    After a whole paragraph the next piece begins up to ``overlap`` characters earlier, at a sentence or a word.
    """
    marks = _Marks(text or "")
    chunks: list[str] = []
    start = covered = 0
    end_of_text = len(marks.text)
    while covered < end_of_text:
        end = marks.last(marks.paragraphs, covered, start + size)
        whole = end is not None
        if not whole:
            low, high = max(start + size - BREAK_RANGE, covered), start + size
            end = marks.last(marks.sentences, low, high) or marks.last(marks.words, low, high) or high
        piece = marks.text[start:end].strip()
        if piece:
            chunks.append(piece)
        covered = start = end
        if whole and covered < end_of_text:
            back = len(piece) if len(piece) <= overlap else overlap
            start = covered - back if back == len(piece) else marks.first_start(covered - back, covered)
        while start == covered < end_of_text and marks.text[covered].isspace():
            covered = start = covered + 1
    return chunks


def chunk_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``(chunk_id, doc_id, chunk_index, content)``; the id is a hash of document and index."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[["doc_id"]].copy()
            out["pieces"] = [chunk_text(t, size, overlap) for t in pdf["text"]]
            yield out

    pieces = rows.mapInPandas(run, f"doc_id {kind}, pieces array<string>")
    return pieces.select("doc_id", F.posexplode("pieces").alias("chunk_index", "content")).select(
        F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "content"
    )
