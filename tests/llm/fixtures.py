"""Small tables with the awkward rows, and plain restatements of the contracts."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _text string, key string, size string, sid string, target string"


def sentence(rng: random.Random, n: int, words: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(seed: int = 0) -> list[tuple]:
    """NULLs in every column, empty, blank, short and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = sentence(rng, 70)
    texts = [
        base, base, base.replace(" ", "\n\t", 3), " ".join(near), "", None, "   ", "one two", "ONE two", "one two three four five",
        sentence(rng, 30_000), sentence(rng, 80) + " " + passage + " " + sentence(rng, 60), passage + " " + sentence(rng, 90),
        "é ü 漢字 ß 🙂 " + sentence(rng, 40), sentence(rng, 200),
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "é")[i % 4], None, "x", "y", None, "1", "2", "3") for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, None, None, 5, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return rows


def words(text: str | None, pattern: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(pattern, lowered)


NOT_SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
