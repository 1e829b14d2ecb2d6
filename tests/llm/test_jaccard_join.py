import random

import numpy as np
import pytest

from tablelens.llm import jaccard_join as jj
from tests.llm.fixtures import NOT_SPACE, SCHEMA, sentence, words


def shingles(text):
    w = words(text, NOT_SPACE)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * (c := len(x & y)) >= 75 * (len(x) + len(y) - c):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), low.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def family(rng, n, base, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w[: len(w) - rng.randrange(8)]))
    return out


def test_awkward_rows(odd, odd_rows, none):
    assert sorted(map(tuple, jj.jaccard_components(odd).collect()), key=repr) == brute(odd_rows)
    kept = jj.one_per_component(odd)
    assert kept.columns == odd.columns
    rows = [tuple(r) for r in kept.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    # rows without an id: one of each component that has no other, and every text without words
    nameless = [(None, t, *[None] * 9) for t in ("a b c d e f g", "a b c d e f g", "x y z", "", None)]
    assert sorted(map(repr, (r[1] for r in jj.one_per_component(odd.sparkSession.createDataFrame(nameless, SCHEMA)).collect()))) in (
        ["''", "'a b c d e f g'", "'x y z'"], ["'a b c d e f g'", "'x y z'", "None"])
    assert jj.jaccard_components(none).count() == 0


@pytest.mark.parametrize("hot,block", [(64, 4096), (4, 7)])
def test_families_at_the_threshold(spark, hot, block):
    """Small ``hot`` and ``block`` send the same pairs over the paths for frequent shingles and split clusters."""
    rng = random.Random(8)
    passage = sentence(rng, 30)
    texts = []
    for i in range(14):
        texts += family(rng, 2 + i % 9, sentence(rng, 30 + 15 * i), 2 + i)
    texts += [f"{passage} {sentence(rng, 5 + i % 40)}" for i in range(60)]
    rows = [(i, t, *[None] * 9) for i, t in enumerate(texts)]
    got = jj.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4), hot=hot, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_tree_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 70):
        base = [rng.integers(-(2**62), 2**62, rng.integers(4, 60)) for _ in range(max(1, n // 6))]
        sets = []
        for i in range(n):
            s = base[i % len(base)].copy()
            change = rng.random(len(s)) < 0.12
            s[change] = rng.integers(-(2**62), 2**62, change.sum())
            sets.append(np.unique(s))
        root = list(range(n))
        find = lambda i: i if root[i] == i else find(root[i])
        for i in range(n):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                    root[find(i)] = find(j)
        want = [find(i) for i in range(n)]
        root = list(range(n))
        for a, b in jj.SignatureTree(sets).links():
            root[find(a)] = find(b)
        got = [find(i) for i in range(n)]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(n) for j in range(i))


def test_few_shared_shingles_make_no_candidates(spark, monkeypatch):
    """Sets of unlike size with a few common shingles are not linked, so they must not fall into clusters that grow."""
    rng = random.Random(5)
    common = [sentence(rng, 5) for _ in range(40)]
    texts = [" ".join([sentence(rng, 20 + i % 40), *rng.sample(common, 2), sentence(rng, 4)]) for i in range(600)]
    rows = [(i, t, *[None] * 9) for i, t in enumerate(texts)]
    seen = []
    links = jj._tree_links
    monkeypatch.setattr(jj, "_tree_links", lambda sets, percent: seen.append(sets.count()) or links(sets, percent))
    got = jj.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert seen[0] < 60  # of 600; one common shingle was enough for 232 of them


def test_parts_of_a_family_are_joined_before_lists_are_met(spark, monkeypatch):
    """A family in several parts joins by few pairs; its hot lists must not be met all with all."""
    rng = random.Random(6)
    texts = family(rng, 120, sentence(rng, 120), 3)
    rows = [(i, t, *[None] * 9) for i, t in enumerate(texts)]
    met = []
    pairs = jj._hot_pairs
    monkeypatch.setattr(jj, "_hot_pairs", lambda *a: met.append(pairs(*a).count()) or pairs(*a))
    got = jj.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4), hot=4, block=30)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert met[0] < 120
