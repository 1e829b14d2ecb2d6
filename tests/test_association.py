import random
from itertools import combinations

import pytest

from tablelens.operators import association as a


def tx(spark, sets):
    return spark.createDataFrame([(sorted(s),) for s in sets], "items array<string>")


def test_support_exactly_at_the_limit_is_kept(spark):
    sets = [{"x"}] * 7 + [{"y"}] * 6 + [{"z"}] * 87
    got = {tuple(r["items"]): r["freq"] for r in a.frequent_itemsets(tx(spark, sets), 0.07).collect()}
    assert got == {("x",): 7, ("z",): 87}


def test_rules_against_brute_force(spark):
    sets = [{"a", "b", "c"}] * 5 + [{"a", "b"}] * 3 + [{"a", "d"}] * 2 + [{"c"}] * 4 + [{"b", "c", "d"}]
    n = len(sets)
    support = {}
    for size in range(1, 5):
        for combo in combinations("abcd", size):
            s = sum(set(combo) <= t for t in sets) / n
            if s >= 0.1:
                support[combo] = s
    want = {}
    for items, s in support.items():
        for size in range(1, len(items)):
            for left in combinations(items, size):
                right = tuple(sorted(set(items) - set(left)))
                conf = s / support[left]
                if conf >= 0.5 and conf / support[right] >= 1:
                    want[left, right] = (s, conf, None if conf == 1 else (1 - support[right]) / (1 - conf))
    rules = a.association_rules(a.frequent_itemsets(tx(spark, sets), 0.1)).collect()
    got = {(tuple(r["antecedent"]), tuple(r["consequent"])): (r["support"], r["confidence"], r["conviction"]) for r in rules}
    assert set(got) == set(want)
    assert any(len(right) > 1 for _, right in got)
    for key, values in want.items():
        assert got[key] == tuple(None if v is None else pytest.approx(v) for v in values)


def test_long_rows_give_the_same_sets(spark):
    pairs = [(i, item) for i in range(30) for item in ("a", "b", f"r{i}", *(["c"] if i % 2 else [])) for _ in range(2)]
    df = spark.createDataFrame(pairs, "basket long, item string")
    got = {tuple(r["items"]): (r["freq"], r["n"]) for r in a.frequent_itemsets_of_pairs(df, "basket", "item", 0.3).collect()}
    assert got[("a", "b", "c")] == (15, 30)
    assert len(got) == 7


def brute(sets, limit, max_size=9):
    items = sorted(set().union(*sets))
    counts = {c: sum(set(c) <= t for t in sets) for size in range(1, max_size + 1) for c in combinations(items, size)}
    return {c: f for c, f in counts.items() if f and f >= limit * len(sets) - 1e-9}


@pytest.mark.parametrize("max_size", [None, 1, 2, 4])
def test_sets_over_many_blocks(spark, max_size):
    rng = random.Random(5)
    sets = [{x for x in "abcdefg" if rng.random() < 0.15 + 0.1 * (ord(x) - 97)} for _ in range(3000)]
    df = tx(spark, sets)
    want = brute(sets, 0.05, max_size or 7)
    assert max(map(len, want)) == (max_size or max(map(len, want)))
    for given in (df, df.repartition(5), df.coalesce(1)):
        got = a.frequent_itemsets(given, 0.05, max_size).collect()
        assert {tuple(r["items"]): r["freq"] for r in got} == want and len(got) == len(want)
    long = [(i, x) for i, s in enumerate(sets) for x in s for _ in range(2)]
    pairs = spark.createDataFrame(long, "basket long, item string")
    n = len([s for s in sets if s])
    got = a.frequent_itemsets_of_pairs(pairs, "basket", "item", 0.05, max_size).collect()
    assert {tuple(r["items"]): r["freq"] for r in got} == brute([s for s in sets if s], 0.05, max_size or 7)
    assert {r["n"] for r in got} == {n}


def test_empty_and_odd_transactions(spark):
    rows = [(["a", None, "a", "b"],), ([],), (None,), ([None],), (["b"],)]
    got = {tuple(r["items"]): (r["freq"], r["n"]) for r in a.frequent_itemsets(spark.createDataFrame(rows, "items array<string>"), 0.2).collect()}
    assert got == {("a",): (1, 5), ("b",): (2, 5), ("a", "b"): (1, 5)}
    assert a.frequent_itemsets(tx(spark, [{"a"}]).limit(0), 0.1).count() == 0


def test_one_basket_with_most_rows(spark):
    rows = [(0, f"i{k}") for k in range(5000)] + [(b, f"i{k}") for b in range(1, 40) for k in (1, 2)]
    got = a.frequent_itemsets_of_pairs(spark.createDataFrame(rows, "basket long, item string"), "basket", "item", 0.5).collect()
    assert {tuple(r["items"]): r["freq"] for r in got} == {("i1",): 40, ("i2",): 40, ("i1", "i2"): 40}


def test_row_transactions_drop_empty_cells(spark):
    df = spark.createDataFrame([("x", None), (None, None), ("y", "z")], "p string, q string")
    assert sorted(tuple(r["items"]) for r in a.row_transactions(df, ["p", "q"]).collect()) == [("p=x",), ("p=y", "q=z")]


def test_table_rules_skip_columns_of_many_values(spark):
    df = spark.createDataFrame([("u" if i % 2 else "v", i, i % 2) for i in range(40)], "s string, many long, few long")
    rules = a.rules_of_table(df).collect()
    items = {x for r in rules for x in (*r["antecedent"], *r["consequent"])}
    assert items == {"s=u", "s=v", "few=0", "few=1"}


def test_rules_of_a_set_of_31_items(spark):
    items = [f"i{k:02d}" for k in range(31)]
    rows = [(items, 31, 50, 0.5, 100)] + [(items[:k] + items[k + 1 :], 30, 60, 0.6, 100) for k in range(31)] + [([x], 1, 80, 0.8, 100) for x in items]
    sets = spark.createDataFrame(rows, "items array<string>, size int, freq long, support double, n long")
    got = a.association_rules(sets, 0.5, 1.0).collect()
    assert len(got) == 31 and all(len(r["antecedent"]) == 30 and len(r["consequent"]) == 1 for r in got)
