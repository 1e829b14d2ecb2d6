import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, shard string, support string, k string"


def brute_force(rows, support, top=co.TOP):
    """The contract, phrase by phrase, for rows ``(doc_id, text, lang)``."""
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    found = {}
    for (lang, words), a in candidates.items():
        inside = [b for (other, longer), b in candidates.items() if other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def texts(seed=0, n=300):
    rng = random.Random(seed)
    phrases = ["New York city hall", "out of order", "é漢 ü", "red\ttape", "a a a a a"]
    rows = []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.8)) % 40}" for _ in range(30)]
        for _ in range(2):
            words[rng.randrange(30)] = rng.choice(phrases)
        words[rng.randrange(30)] += rng.choice(".,;:!?\n\r\x0b\x0c")
        rows.append((i, " ".join(words), rng.choice(["en", "en", "en", "de", None])))
    rows += [(None, None, None), (1, "", "en"), (None, " \t.. ,", "de"), rows[0], rows[0], (900, "only here", "fr"), (901, None, None), (902, "x y " * 20_000, "long")]
    return rows


def found(spark, rows, parts=4, **options):
    df = spark.createDataFrame([(*r, None, "s", "k") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in co.collocations(df, **options).collect())


@pytest.mark.parametrize("options", [{"support": 30}, {"support": 7, "n_shards": 3}, {"support": 9, "bits": (6, 6)}, {"support": 12, "n_shards": 16, "top": 5}, {"support": 5, "n_shards": 1}])
def test_against_brute_force(spark, options):
    rows = texts()
    assert found(spark, rows, **options) == brute_force(rows, options["support"], options.get("top", co.TOP))


def test_small_blocks_and_hand_overs(spark, monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 50)
    monkeypatch.setattr(co, "KEPT", 20)
    rows = texts(3, 120)
    assert found(spark, rows, support=6) == brute_force(rows, 6)


def test_one_text_with_most_words(spark):
    rows = [(7, "to be or not to be. " * 400, "en")] + texts(5, 60)
    assert found(spark, rows, support=10) == brute_force(rows, 10)


def test_no_documents(spark):
    assert found(spark, []) == []


def test_counts_beyond_64_bits(spark):
    row = spark.createDataFrame([(6 * 10**18, 7 * 10**18, 8 * 10**18)], "a long, l long, r long")
    got = row.select(F.expr("(cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + r)")).first()[0]
    assert got == 2_000_000 * 6 * 10**18 // (15 * 10**18)


@pytest.mark.parametrize("bits", [(4, 4), (17, 20), (10, 12)])
def test_bitmap_holds_every_key(spark, bits):
    keys = np.random.default_rng(1).integers(0, 1 << 64, 3000, dtype=np.uint64)
    made = co.bitmap_of(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k long"), F.col("k"), bits)
    assert made.has(keys).all() and len(made.data) <= max(1 << bits[1], 1 << 15) // 8
    if bits[1] > 16:
        assert made.has(np.random.default_rng(2).integers(0, 1 << 64, 3000, dtype=np.uint64)).mean() < 0.2
