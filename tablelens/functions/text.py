"""Text column expressions: trimming, paragraphs, tokens, suffix rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tablelens.functions.lexicon import SUFFIX_RULES


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_space(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    """Non-empty trimmed pieces between runs of line breaks."""
    return F.filter(F.transform(F.split(text, r"\n+"), strip_space), lambda p: p != "")


def word_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters (matched before lowering)."""
    runs = F.lower(F.trim(F.regexp_replace(text, "[^a-zA-Z]+", " ")))
    return F.filter(F.split(runs, " "), lambda w: w != "")


def clean_word(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "[^a-zA-Z]", ""))


def strip_suffix(word: Column) -> Column:
    """Lemma by the first matching suffix rule, else the word itself."""
    out = None
    for pattern, replacement in SUFFIX_RULES:
        hit, lemma = word.rlike(pattern), F.regexp_replace(word, pattern, replacement)
        out = F.when(hit, lemma) if out is None else out.when(hit, lemma)
    return out.otherwise(word)


def search_tokens(text: Column) -> Column:
    """Retrieval tokens: lower case, word characters and CJK kept, longer than one character."""
    kept = F.regexp_replace(F.lower(text), r"[^\w一-龥\s]", " ")
    return F.filter(F.split(kept, r"\s+"), lambda t: F.length(t) > 1)
