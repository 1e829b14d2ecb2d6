"""Language ID by compression: the language whose dictionary makes the text smallest.

Each language gets a zstandard raw-content dictionary from a bounded sample of its texts. A text is folded
(lower case, ASCII non-letters blank), cut into pieces that cover all of it, and every piece is compressed with
every dictionary. A narrow margin between the two smallest totals rejects the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tablelens.llm.common import fold_of, with_whole_rows

PIECES = 256  # sampled pieces per language: the bound of what is learned from
PIECE_CHARS = 400
PIECE_BYTES = 2048  # compressed at once, so that a long text does not become its own dictionary
LEVEL = 6
NARROW = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def fold(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_BLANK).split())


def learn(labelled: DataFrame, pieces: int = PIECES) -> dict[str, bytes]:
    """Dictionary content per language from ``labelled(_id, _text, _lang)``.

    From each language the texts with the smallest id hash are taken, ``pieces`` of them at most, and of each a
    piece of ``PIECE_CHARS`` characters at a place given by the hash. Languages are few; their counts set the
    hash bound, so that only about twice the sample leaves the table.
    """
    rows = labelled.where("_lang is not null and _text is not null and length(_text) > 0")
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 40)))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    bound = F.coalesce(*[F.when(F.col("_lang") == lang, F.lit(int(min(1.0, 2 * pieces / n) * (1 << 40)))) for lang, n in counts.items()])
    place = F.pmod(F.col("_h"), F.greatest(F.char_length("_text") - PIECE_CHARS, F.lit(0)) + 1) + 1
    picked = rows.where(F.col("_h") < bound).select("_lang", "_h", F.substring("_text", place.cast("int"), F.lit(PIECE_CHARS)).alias("_piece"))
    out: dict[str, list] = {}
    for r in picked.collect():
        out.setdefault(r["_lang"], []).append((r["_h"], fold(r["_piece"])))
    return {lang: b" ".join(dict.fromkeys(p for _, p in sorted(got)[:pieces])) for lang, got in sorted(out.items())}


def compressors(contents: dict[str, bytes]) -> list:
    made = []
    for content in contents.values():
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def classify(text: str | None, names: list[str], coders: list) -> tuple[str, float, bool]:
    """Language, score and whether the margin is wide enough. Score: ``m / (m + NARROW)`` of the relative margin ``m``."""
    if not text or not names or not _LETTER.search(text):
        return UNKNOWN, 0.0, False
    data = fold(text)
    pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), name) for c, name in zip(coders, names))
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
    return sizes[0][1], margin / (margin + NARROW), margin >= NARROW


def _training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.where(fold_of(f"`{id_col}`") != 0)
    return rows.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang"))


def _scored(rows: DataFrame, text: str, contents: dict[str, bytes]) -> DataFrame:
    kept = [c for c in rows.columns if c != text]
    at_text = rows.columns.index(text)
    names = list(contents)

    def run(batches) -> Iterator[pa.RecordBatch]:
        coders = compressors(contents)
        for batch in batches:
            got = [classify(t.as_py(), names, coders) for t in batch.column(at_text)]
            lang, score, clear = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(clear, pa.bool_())],
                names=[*kept, "lang_pred", "score", "accepted"],
            )

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` per row of ``docs``.

    Learns from the rows whose id fold is not 0. NULL, empty and letterless texts are ``und`` with score 0 and not
    accepted, as is everything where no language can be learned. Equal totals go to the first language by name,
    with score 0. Every row is judged by itself, so repeated rows and NULL ids give rows of their own.
    """
    contents = learn(_training(docs, id_col, text_col, lang_col))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold_of(f"`{id_col}`") == 0).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))
    return _scored(slim, "_text", contents)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is clear, with all their columns."""
    contents = learn(_training(docs, id_col, text_col, lang_col))
    rows = _scored(with_whole_rows(docs, F.col(f"`{text_col}`").alias("_text")), "_text", contents)
    return rows.where("accepted").select("_row.*")
