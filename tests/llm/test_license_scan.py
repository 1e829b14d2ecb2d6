import math
import random
import re
from collections import Counter

from tablelens.llm import license_scan as ls

FILES = "doc_id long, path string, text string, _text string, license string"


def rows():
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    return [
        (1, "a/LICENSE", f"{mit}", None, None), (2, "a/x.txt", "plain words\nmore words", None, None), (3, "a/b/c/y.txt", "deep words", None, None),
        (4, "a/b/COPYING", f"intro\n{gpl}\nend", None, None), (5, "a/b/z.txt", f"own\n# SPDX-License-Identifier: Apache-2.0\n{'word ' * 3000}", None, None),
        (6, "d/q.txt", None, None, None), (7, None, mit, None, None), (8, "top.txt", "", None, None), (None, "a/b/n.txt", "no id", "x", "y"),
        (2, "a/x.txt", "plain words\nmore words", None, None), (9, "ab/w.txt", "not below a", None, None), (10, "e/LICENSE.md", "licence lost", None, None),
        (11, "a/b/c/d/h.txt", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in\ncompliance with the License. You may obtain a copy of the License at", None, None),
    ]


def test_own_and_inherited(spark):
    got = ls.license_scan(spark.createDataFrame(rows(), FILES).repartition(3), "doc_id", "path").collect()
    assert len(got) == len(rows())
    by = {(r.doc_id, r.path): (r.own_license, r.license, r.license_from) for r in got}
    assert by[(1, "a/LICENSE")] == ("MIT", "MIT", None)
    assert by[(2, "a/x.txt")] == (None, "MIT", "a")
    assert by[(3, "a/b/c/y.txt")] == (None, "GPL-3.0", "a/b")
    assert by[(4, "a/b/COPYING")] == ("GPL-3.0", "GPL-3.0", None)
    assert by[(5, "a/b/z.txt")] == ("Apache-2.0", "Apache-2.0", None)
    assert by[(6, "d/q.txt")] == by[(8, "top.txt")] == by[(9, "ab/w.txt")] == by[(10, "e/LICENSE.md")] == (None, None, None)
    assert by[(7, None)] == ("MIT", "MIT", None)
    assert by[(None, "a/b/n.txt")] == (None, "GPL-3.0", "a/b")
    assert by[(11, "a/b/c/d/h.txt")][0] == "Apache-2.0"


def test_lines_without_an_anchor_cannot_reach_the_threshold():
    counts = {"the": 90, "of": 80, "license": 3, "work": 40}
    idf, vectors = ls.template_weights(counts, 100)
    anchors = ls.anchors(idf, vectors, ls.THRESHOLD)
    for v in vectors:
        assert math.sqrt(sum(x * x for w, x in v.items() if w not in anchors)) < ls.THRESHOLD
        assert math.isclose(sum(x * x for x in v.values()), 1)


def test_empty(spark):
    assert ls.license_scan(spark.createDataFrame([], FILES), "doc_id", "path").count() == 0


def nearest(texts):
    """By brute force: name and cosine of the nearest template over all lines and all windows of its length."""
    bags = [ls.words_of(t) for t in texts]
    idf, vectors = ls.template_weights(Counter(w for b in bags for w in set(b)), len(texts))
    unseen = ls.template_weights({}, len(texts), (("", "x"),))[0]["x"]
    out = []
    for text, bag in zip(texts, bags):
        found = []
        for (name, template), v in zip(ls.TEMPLATES, vectors):
            n = len(ls.words_of(template))
            parts = [ls.words_of(x) for x in text.split("\n")] + [bag[i : i + n] for i in range(max(1, len(bag) - n + 1))]
            for tf in map(Counter, filter(None, parts)):
                norm = math.sqrt(sum((k * idf.get(w, unseen)) ** 2 for w, k in tf.items()))
                found.append((round(sum(k * idf[w] * v[w] for w, k in tf.items() if w in v) / norm, 6), name))
        best = min(((-s, n) for s, n in found if s >= ls.THRESHOLD), default=None)
        out.append(best and (best[1], -best[0]))
    return out


def test_windows_equal_brute_force(spark, monkeypatch):
    """Notices inside lines, on one long line, wrapped anywhere, mangled, at either end and across blocks."""
    monkeypatch.setattr(ls, "BLOCK", 16)
    rng = random.Random(5)
    filler = lambda n: [rng.choice(["alpha", "beta", "the", "software", "license", "under", "version", "any", "of", "zeta9"]) + rng.choice(["", "", "x"]) for _ in range(n)]
    texts = []
    for k in range(90):
        body = rng.choice(ls.TEMPLATES)[1].split()
        if k % 3 == 1:
            body = [w for w in body if rng.random() < 0.8]
        elif k % 3 == 2:
            body = [x for w in body for x in ([w] if rng.random() < 0.8 else [w, *filler(1)])]
        words = filler(rng.randrange(0, 60)) + body + filler(rng.randrange(0, 60))
        texts.append("".join(w + (rng.choice(["\n", " "]) if k % 2 else " ") for w in words))
    texts += [" ".join(filler(80)) for _ in range(20)] + ["license", "...", "\n"]
    expected = nearest(texts)
    # lines broken into runs are parts of their own and are tested above
    one_line = [i for i in range(len(texts)) if "\n" not in texts[i].strip()]
    files = spark.createDataFrame([(i, "f", t, None, None) for i, t in enumerate(texts)], FILES)
    got = {r.doc_id: r.own_license and (r.own_license, r.own_score) for r in ls.license_scan(files, "doc_id", "path").collect()}
    for i, want in enumerate(expected):
        if i in one_line or want is None:
            assert i not in one_line or (got[i] is None) == (want is None), texts[i]
        if want is not None and (i in one_line or got[i][1] < want[1]):
            assert got[i][0] == want[0] and math.isclose(got[i][1], want[1], abs_tol=2e-6), texts[i]
    assert sum(e is not None for e in expected) > 40


def test_a_notice_that_shares_its_line(spark):
    notices = [
        ("MIT", "This project is licensed under the MIT License, see the LICENSE file for details"),
        ("MIT", "Copyright (c) 2020 Jane Doe. Released under the MIT License"),
        ("CC-BY-4.0", "Pictures and words by several authors around this small town, licensed under CC BY 4.0 since the spring of last year"),
        ("Apache-2.0", "one two three four five six seven eight nine Licensed under the Apache License,\nVersion 2.0 ten eleven twelve thirteen"),
    ]
    rows = [(i, f"d{i}/LICENSE", t, None, None) for i, (_, t) in enumerate(notices)] + [(10 + i, f"d{i}/sub/x.txt", f"plain {i}", None, None) for i in range(4)]
    got = {r.doc_id: r for r in ls.license_scan(spark.createDataFrame(rows, FILES), "doc_id", "path").collect()}
    for i, (name, _) in enumerate(notices):
        assert (got[i].own_license, got[i].own_score) == (name, 1.0)
        assert (got[10 + i].own_license, got[10 + i].license, got[10 + i].license_from) == (None, name, f"d{i}")
