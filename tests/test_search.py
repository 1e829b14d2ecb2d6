"""The searches against all pairs."""

import math
import random
import re

import numpy as np
import pytest

from tablelens.operators import search


def tokens(text):
    return [t for t in re.split(r"\s+", re.sub(r"[^\w\s]", " ", text.lower())) if len(t) > 1]


def all_pairs(docs, asked, vw, kw, k):
    bags = {i: tokens(t or "") for i, t in docs}
    df = {}
    for bag in bags.values():
        for t in set(bag):
            df[t] = df.get(t, 0) + 1

    def vec(bag):
        v = {t: bag.count(t) / len(bag) * math.log(len(docs) / df[t]) for t in bag if t in df}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()} if n else {}

    vectors, out = {i: vec(b) for i, b in bags.items()}, {}
    for q, text in asked:
        bag = tokens(text or "")
        mine = vec(bag)
        scores = []
        for i, t in docs:
            share = sum(w in (t or "").lower() for w in bag) / len(bag) if bag else 0.0
            scores.append((-round(vw * sum(x * vectors[i].get(w, 0.0) for w, x in mine.items()) + kw * share, 7), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("seed,vw,kw,aside", [(1, 0.7, 0.3, 0.7), (2, 1.0, 0.0, 0.95), (3, 0.2, 0.8, 0.3), (4, 0.7, 0.3, 0.99)])
def test_text_search_against_all_pairs(spark, monkeypatch, seed, vw, kw, aside):
    monkeypatch.setattr(search, "ASIDE", aside)
    monkeypatch.setattr(search, "SEED_LISTS", seed)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(1 + int(rng.paretovariate(1.2)) % 6))
    vocab = [word() for _ in range(120)]
    text = lambda n: " ".join(vocab[int(rng.paretovariate(0.7)) % len(vocab)] for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(150)] + [(150, None), (151, "")]
    docs += [(200 + i, docs[3][1]) for i in range(5)]
    asked = [(i, text(rng.randrange(1, 12))) for i in range(60)] + [(60, docs[7][1]), (61, "unknown words"), (62, ""), (63, "a b"), (64, None)]
    found = search.text_search(spark.createDataFrame(asked, "query_id long, text string").repartition(3), spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 4, vector_weight=vw, keyword_weight=kw)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = all_pairs(docs, asked, vw, kw, 4)
    assert set(got) == set(want)
    for q, rows in want.items():
        assert [s for _, s in rows] == pytest.approx([s for _, s in got[q]], abs=1e-6)
        # equal scores may differ in the last digits here; where they do not, ids are the same
        if len({round(s, 5) for _, s in rows}) == len(rows):
            assert [i for i, _ in rows] == [i for i, _ in got[q]]


def test_full_sums_give_the_same_as_bounds(spark, monkeypatch):
    """Many pairs left by weak bounds are summed up document by document."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.randrange(1, 12)))
    docs = spark.createDataFrame([(i, text()) for i in range(60)] + [(60, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, text()) for i in range(8)] + [(8, "zz")], "query_id long, text string")
    found = lambda: sorted(map(tuple, search.text_search(asked, docs, 3, vector_weight=1.0, keyword_weight=0.0, use_idf=False).collect()))
    want = found()
    monkeypatch.setattr(search, "FEW_ROWS", 0)
    assert found() == want and len(want) == 27


def test_no_queries_and_no_documents(spark):
    asked, docs = spark.createDataFrame([], "query_id long, text string"), spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert search.text_search(asked, docs).count() == 0
    assert search.text_search(spark.createDataFrame([(1, "a text")], asked.schema), docs.where("false")).count() == 0


def test_lists_hold_only_the_tokens_of_queries(spark):
    docs = spark.createDataFrame([(1, "red blue blue"), (2, "red green"), (3, None), (4, "grey")], "doc_id long, text string")
    counts, stats, norms = search.postings(docs)
    lists = search.lists_of(counts, stats.where("token = 'blue'").select("token", "idf"), norms).collect()
    red, blue = math.log(2) / 3, math.log(4) * 2 / 3
    assert [(r["doc_id"], r["token"]) for r in lists] == [(1, "blue")] and lists[0]["w"] == pytest.approx(blue / math.hypot(red, blue))


@pytest.mark.parametrize("seed,pivots", [(1, 1), (2, 8), (3, 32), (4, 500)])
def test_vector_search_against_all_pairs(spark, seed, pivots):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 12)) * 3
    mat = centres[rng.integers(0, 5, 400)] + rng.normal(size=(400, 12)) * (0.2 if seed % 2 else 2.0)
    mat[[3, 77]] = 0.0
    mat[100:120] = mat[100]
    asked = np.vstack([mat[rng.integers(0, 400, 30)], rng.normal(size=(10, 12)), np.zeros((1, 12)), -mat[:2]])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)] + [(900, None), (None, [1.0] * 12)], "doc_id long, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(None, [1.0] * 12)], "query_id long, vector array<double>")
    got = {}
    for r in search.vector_search(queries, vectors, 6, pivots).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    scores = np.round(unit(asked) @ unit(mat).T, 9) + 0.0
    assert len(got) == len(asked)
    for q, row in enumerate(scores):
        order = np.lexsort((np.arange(len(row)), -row))[:6]
        assert [s for _, s in got[q]] == pytest.approx(row[order].tolist(), abs=2e-9)
        if np.min(np.abs(np.diff(np.sort(row)[-7:]))) > 1e-8:
            assert [i for i, _ in got[q]] == order.tolist()


def test_words_around(spark):
    rng = random.Random(6)
    words = list({"".join(rng.choice("abé漢_1") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    parts = list({"".join(rng.choice("abé漢_1") for _ in range(rng.randrange(1, 5))) for _ in range(80)}) + [""]
    got = search.words_around(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert sorted(map(tuple, got)) == sorted((p, w) for p in parts if p for w in words if p in w)


def test_mentions(spark):
    questions = spark.createDataFrame([(1, "Sales of Orders and ORDERS_old"), (2, "customers"), (3, None), (4, "a ++ b"), (5, "")], "question_id long, text string")
    items = spark.createDataFrame([(10, "orders"), (11, "Sales"), (12, "customer"), (13, "x"), (14, "Orders"), (15, "++"), (16, ""), (17, None), (18, "of orders AND o")], "item_id long, name string")
    got = sorted(map(tuple, search.mentions(questions, items).collect()))
    assert got == [(1, 10), (1, 11), (1, 14), (1, 18), (2, 12), (4, 15)]


def test_mentions_against_all_pairs(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abAB  .-é") for _ in range(n))
    questions = [(i, text(rng.randrange(80))) for i in range(150)]
    items = [(i, text(rng.randrange(1, 9))) for i in range(300)] + [(1000, "a"), (1000, "a")]
    got = search.mentions(spark.createDataFrame(questions, "question_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, name string").repartition(2)).collect()
    assert sorted(map(tuple, got)) == sorted((q, i) for q, t in questions for i, n in items if n and n.lower() in t.lower())
