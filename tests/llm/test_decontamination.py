import hashlib
import random

import numpy as np
import pytest

from tablelens.llm import decontamination as dc
from tests.llm.fixtures import ALNUM, awkward, sentence, words

BENCH = "item_id long, text string, doc_id string"


def brute(docs, items, window=10):
    out = []
    for row in docs:
        w = words(row[1], ALNUM)
        hit, found = set(), set()
        for item in items:
            b = words(item[1], ALNUM)
            m = min(len(b), window)
            for j in range(len(b) - m + 1 if m else 0):
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == b[j : j + m]:
                        hit.update(range(i, i + m))
                        found.add("" if item[0] is None else str(item[0]))
        out.append((row[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(odd_rows):
    long = odd_rows[10][1].split()
    return [
        (7, " ".join(long[100:140]) + " other words", None), (10, " ".join(long[120:131]), None), (7, "one two", None), (None, "W1! w2", None), (3, "", None),
        (4, None, None), (5, "...", None), (6, " ".join(odd_rows[0][1].split()[:9]).upper(), None), (8, "é ü 漢字 ß", None), (9, " ".join(long[-10:]), None),
    ]


def test_awkward_rows(spark, odd, odd_rows, items):
    bench = spark.createDataFrame(items, BENCH)
    assert sorted(map(tuple, dc.contamination(odd, bench).collect()), key=repr) == brute(odd_rows, items)
    clean = dc.without_contaminated(odd, bench)
    assert clean.columns == odd.columns
    assert clean.count() == sum(not r[-1] for r in brute(odd_rows, items))


def test_blocks_of_the_benchmark_add_up(spark, odd, odd_rows, items, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 60)
    assert sorted(map(tuple, dc.contamination(odd, spark.createDataFrame(items, BENCH)).collect()), key=repr) == brute(odd_rows, items)


def test_longest_matches(spark, odd, odd_rows, items):
    rows = [r for r in dc.longest_matches(odd, spark.createDataFrame(items, BENCH)).collect() if r.item_id == "7" and r.doc_id == 10]
    assert max((r.n_words, r.doc_word, r.item_word) for r in rows) == (40, 100, 0)


def test_empty(spark, odd, none, items):
    assert dc.contamination(none, spark.createDataFrame(items, BENCH)).count() == 0
    assert dc.contamination(odd, spark.createDataFrame([], BENCH)).where("n_hit > 0 or n_items > 0").count() == 0


def test_suffix_array_is_in_word_order():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 2), (2, 1), (50, 2), (400, 3), (300, 40)):
        codes = rng.integers(1, kinds + 1, n)
        cut = np.sort(rng.choice(np.arange(1, n), min(3, n - 1), replace=False)) if n > 1 else np.zeros(0, int)
        ends = np.repeat(np.append(cut, n), np.diff(np.concatenate(([0], cut, [n]))))
        sa, _ = dc.suffix_array(codes.astype(np.int64), ends - np.arange(n))
        suffix = [tuple(codes[i : ends[i]]) for i in sa]
        assert sorted(sa.tolist()) == list(range(n)) and suffix == sorted(suffix)
