import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import retrieval as ret, search

DOCS = ["the cat sat on the mat", "a dog and a cat", "", "dogs chase cats", "quantum field theory of cats", "the cat sat on the mat", "zz"]
ASKED = ["cat mat", "Dog! and quantum-field", "nothing here", "cat cat field"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").repartition(3, "doc_id")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id long, text string")


def tokens(text):
    return [t for t in re.split(r"\s+", re.sub(r"[^\w\s]", " ", text.lower())) if len(t) > 1]


def brute(use_idf=True, vw=0.7, kw=0.3, k=3):
    bags = [tokens(t) for t in DOCS]
    df = {t: sum(t in b for b in bags) for b in bags for t in b}
    idf = {t: math.log(len(DOCS) / n) if use_idf else 1.0 for t, n in df.items()}

    def vec(bag):
        v = {t: bag.count(t) / len(bag) * idf.get(t, 0.0) for t in bag}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()} if n else {}

    out = {}
    for q, text in enumerate(ASKED):
        bag = tokens(text)
        qv = vec([t for t in bag]) if use_idf else vec(bag)
        scores = []
        for d, b in enumerate(bags):
            dv = vec(b)
            s = vw * sum(x * dv.get(t, 0.0) for t, x in qv.items()) + kw * sum(t in DOCS[d].lower() for t in bag) / len(bag)
            scores.append((round(s, 9), d))
        out[q] = sorted(scores, key=lambda x: (-x[0], x[1]))[:k]
    return out


@pytest.mark.parametrize("use_idf,vw,kw", [(True, 0.7, 0.3), (True, 1.0, 0.0), (True, 0.0, 1.0), (False, 1.0, 0.0)])
def test_search_against_brute_force(docs, asked, use_idf, vw, kw):
    rows = search.text_search(asked, docs, 3, vector_weight=vw, keyword_weight=kw, use_idf=use_idf).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((pytest.approx(r["score"], abs=2e-9), r["doc_id"]))
    assert {q: [(s, d) for s, d in v] for q, v in brute(use_idf, vw, kw).items()} == got


def test_vectors_have_length_one(docs):
    norms = ret.tfidf(docs).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n")).collect()
    assert norms and all(r["n"] == pytest.approx(1.0) for r in norms)


def test_vector_search(spark):
    rng = np.random.default_rng(5)
    mat = rng.normal(size=(60, 8))
    mat[7] = 0.0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "doc_id long, vector array<float>").repartition(4)
    queries = spark.createDataFrame([(i, mat[i].tolist()) for i in range(5)], "query_id long, vector array<double>")
    got = {}
    for r in search.vector_search(queries, vectors, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    unit = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-30)
    assert got == {q: list(np.argsort(-(unit @ unit[q]), kind="stable")[:4]) for q in range(5)}


def test_dense_cosine_and_keywords(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], "A Cat", ["cat", "cat", "dog"]), ([0.0, 0.0], [1.0, 1.0], "x", [])], "a array<double>, b array<double>, t string, k array<string>")
    rows = df.select(ret.cosine(F.col("a"), F.col("b")).alias("c"), ret.keyword_score(F.col("t"), F.col("k")).alias("s")).collect()
    assert [(r["c"], r["s"]) for r in rows] == [(pytest.approx(math.sqrt(0.5)), pytest.approx(2 / 3)), (0.0, 0.0)]


def test_store(spark):
    cols = "id long, url string, content string, created_at long, updated_at long"
    old = spark.createDataFrame([(1, "u", "a", 5, 5), (2, "v", "b", 6, 6)], cols)
    new = spark.createDataFrame([(9, "u", "c", 8, 8), (8, "u", "d", 7, 7), (7, "w", "e", 9, 9)], cols)
    got = {r["url"]: (r["id"], r["content"], r["created_at"], r["updated_at"]) for r in ret.upsert_documents(old, new, ["content"]).collect()}
    assert got == {"u": (1, "c", 5, 8), "v": (2, "b", 6, 6), "w": (7, "e", 9, 9)}
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, chunk_index int, content string")
    fresh = spark.createDataFrame([(1, 0, "z")], chunks.schema)
    assert sorted((r["doc_id"], r["content"]) for r in ret.replace_chunks(chunks, fresh).collect()) == [(1, "z"), (2, "c")]


def test_confidence(spark):
    found = spark.createDataFrame([(1, 0.9), (1, 0.6), (2, 0.5), (3, 0.1)], "query_id long, score double")
    assert {r["query_id"]: r["confidence"] for r in ret.confidence(found).collect()} == {1: "high", 2: "medium", 3: "low"}
