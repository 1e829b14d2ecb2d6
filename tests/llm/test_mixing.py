import math
import random
from collections import defaultdict

from tablelens.llm import mixing
from tests.llm.fixtures import NOT_SPACE, SCHEMA, words


def targets(sizes):
    """Water filling, source by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        left = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / left > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else rest * weight[s] / left for s in order}
        full |= over


def check(got, rows, slack):
    size = {}
    for r in rows:
        size.setdefault(r[3], 0)
        size[r[3]] += len(words(r[1], NOT_SPACE))
    want = targets(size)
    taken = defaultdict(int)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= slack(s), (s, taken[s], want[s])


def test_targets_are_met_within_half_a_document(spark):
    rng = random.Random(4)
    rows = [(i, "w " * max(0, int(rng.paretovariate(1.2) * 10) - 8), "en", ("a", "b", "c", None, "Z")[min(4, int(rng.random() ** 2 * 5))], *[None] * 7) for i in range(600)]
    largest = defaultdict(int)
    for r in rows:
        largest[r[3]] = max(largest[r[3]], len(r[1].split()))
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed_documents(df).collect()
    assert len(got) == 600
    check(got, rows, lambda s: largest[s] / 2 + 1)
    again = mixing.mixed_documents(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert len({r.taken // r.size for r in got if r.size}) > 2


def test_awkward_rows(odd, odd_rows):
    got = mixing.mixed_documents(odd).collect()
    assert len(got) == len(odd_rows)
    assert sorted(r.size for r in got) == sorted(len(words(r[1], NOT_SPACE)) for r in odd_rows)
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(odd).select("_row.*").columns == odd.columns


def test_nothing_to_take(spark, none):
    assert mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, None), (2, "", None, "a")], "doc_id long, text string, lang string, source string")
    assert [(r.size, r.taken) for r in mixing.mixed_documents(blank).collect()] == [(0, 0), (0, 0)]


def taken_by_source(got):
    sums = defaultdict(lambda: [0, 0])
    for r in got:
        sums[r.source_size][0] = r.target
        sums[r.source_size][1] += r.taken
    return sums.values()


def test_rows_without_ids_meet_their_targets(spark):
    rows = [(None, "w " * 5, "en", "a")] * 300 + [(None, "w " * 4, "en", "b")] * 900 + [(None, "w " * 7, "en", None)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for given in (df, df.repartition(9), df.coalesce(1)):
        got = mixing.mixed_documents(given).collect()
        assert len(got) == 1300
        sums = taken_by_source(got)
        assert len(sums) == 3 and all(abs(taken - target) <= 4 for target, taken in sums), list(sums)


def test_one_id_on_half_of_a_source(spark):
    rng = random.Random(8)
    rows = [(7 if i % 2 else i, "w " * (24 if i % 2 else rng.randint(1, 30)), "en", "ab"[i % 3 > 1]) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed_documents(df).collect()
    assert len(got) == 1200 and all(r.taken <= 3 * r.size for r in got)
    assert all(abs(taken - target) <= 16 for target, taken in taken_by_source(got))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed_documents(df.repartition(5)).collect()))


def test_ids_of_other_types(spark):
    rows = [(f"d{i % 50}" if i % 7 else None, "w " * (1 + i % 9), "en", "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    got = mixing.mixed_documents(df).collect()
    assert len(got) == 400 and {r.doc_id for r in got} == {r[0] for r in rows}
    assert all(abs(taken - target) <= 5 for target, taken in taken_by_source(got))


def test_columns_with_clashing_names(spark):
    rows = [(i, "w " * (1 + i % 5), "a", i, "x", i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, _last string, _place long, taken long")
    got = mixing.mix(df).collect()
    assert len(got) == 40 and sorted(r._row["_place"] for r in got) == list(range(40))
    assert [r.size for r in sorted(got, key=lambda r: r.doc_id)] == [1 + i % 5 for i in range(40)]
