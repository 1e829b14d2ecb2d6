import math
import statistics

import pytest

from tablelens.operators import anomaly as an


def series(spark, values):
    return an.indexed(spark.createDataFrame(list(enumerate(values)), "i long, value double"), "value", ["i"])


def flagged(df):
    return {r["idx"]: r["score"] for r in df.collect()}


@pytest.mark.parametrize("values", [[], [1.0], [1.0, 9.0], [5.0] * 12])
def test_nothing_on_short_or_constant_data(spark, values):
    rows = series(spark, values)
    for method in (an.zscore_anomalies, an.mad_anomalies, an.window_anomalies, an.iqr_anomalies):
        assert method(rows).count() == 0


def test_zscore_uses_the_sample_deviation_and_a_strict_limit(spark):
    values = [1.0, 2.0, 3.0, 2.0, 1.0, 2.0, 3.0, 2.0, 1.0, 2.0, 3.0, 40.0]
    z = (40 - statistics.mean(values)) / statistics.stdev(values)
    assert flagged(an.zscore_anomalies(series(spark, values))) == {11: pytest.approx(z)}
    assert flagged(an.zscore_anomalies(series(spark, values), limit=z)) == {}


def test_iqr_takes_elements_at_floor_ranks(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0]
    bounds = an.iqr_bounds(series(spark, values)).first()
    assert (bounds["iqr"], bounds["lower"], bounds["upper"]) == (4.0, -3.0, 13.0)
    assert flagged(an.iqr_anomalies(series(spark, values))) == {7: (100 - 13) / 4}


def test_no_spread_flags_every_other_value_without_a_score(spark):
    values = [3.0] * 9 + [4.0]
    assert flagged(an.mad_anomalies(series(spark, values))) == {9: None}
    assert flagged(an.iqr_anomalies(series(spark, values))) == {9: None}


def test_window_excludes_the_row_itself(spark):
    values = [float(i % 3) for i in range(40)]
    values[20] = 30.0
    got = flagged(an.window_anomalies(series(spark, values)))
    around = values[15:20] + values[21:26]
    assert got == {20: pytest.approx((30 - statistics.mean(around)) / statistics.stdev(around))}


def brute_kmeans(values, k=3, share=0.1):
    s, n = sorted(values), len(values)
    centres = [s[int((i + 0.5) * n / k)] for i in range(k)]
    for _ in range(100):
        groups = [[] for _ in range(k)]
        for v in values:
            groups[min(range(k), key=lambda c: abs(v - centres[c]))].append(v)
        new = [statistics.fmean(g) if g else centres[i] for i, g in enumerate(groups)]
        done = all(abs(a - b) < 1e-4 for a, b in zip(new, centres))
        centres = new
        if done:
            break
    dist = [min(abs(v - c) for c in centres) for v in values]
    order = sorted(range(n), key=lambda i: (-dist[i], i))[: math.ceil(n * share)]
    return {i: dist[i] / dist[order[-1]] for i in order}


@pytest.mark.parametrize("n", [6, 25, 91])
def test_kmeans_against_brute_force(spark, n):
    values = [float((i * 37) % 23) + (50.0 if i % 3 == 0 else 0.0) for i in range(n)]
    got = flagged(an.kmeans_anomalies(series(spark, values)))
    want = brute_kmeans(values)
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i]) for i in want)
    assert an.kmeans_anomalies(series(spark, values[:5])).count() == 0


def plain_clusters(values, k):
    s, n = sorted(values), len(values)
    centres = [s[int((i + 0.5) * n / k)] for i in range(k)]
    for _ in range(100):
        groups = [[] for _ in range(k)]
        for v in values:
            groups[min(range(k), key=lambda c: abs(v - centres[c]))].append(v)
        new = [statistics.fmean(g) if g else centres[i] for i, g in enumerate(groups)]
        done = all(abs(a - b) < 1e-4 for a, b in zip(new, centres))
        centres = new
        if done:
            break
    return [(i, c, len(g)) for i, (c, g) in enumerate(zip(centres, groups))]


@pytest.mark.parametrize("held", [1, 5, 4096])
@pytest.mark.parametrize("k,values", [
    (3, [float((i * 37) % 23) + (50.0 if i % 3 == 0 else 0.0) for i in range(91)]), (2, [1.0] * 20), (4, [1.0] * 20 + [9.0, 9.5, -3.25]),
    (5, [(i * i) % 101 / 8 for i in range(200)]), (1, [3.0, 4.5, -1.0]), (3, [0.0, 1.0]),
])
def test_clusters_against_brute_force(spark, monkeypatch, held, k, values):
    monkeypatch.setattr(an._PrefixSums.__init__, "__defaults__", (held,))
    got = sorted(map(tuple, an.kmeans_clusters(series(spark, values), k).collect()))
    want = plain_clusters(values, k) if len(values) >= 2 * k else []
    assert [(i, n) for i, _, n in got] == [(i, n) for i, _, n in want]
    assert [c for _, c, _ in got] == pytest.approx([c for _, c, _ in want])


def test_ensemble_lists_methods(spark):
    values = [1.0, 2.0, 3.0, 2.0] * 6 + [60.0]
    found = an.detect_anomalies(series(spark, values)).collect()
    assert [(r["idx"], r["score"], r["methods"]) for r in found] == [(24, 1.0, ["iqr", "mad", "zscore"])]
    assert an.detect_anomalies(series(spark, values), min_methods=4).count() == 0


def test_zscores_of_the_first_numeric_columns(spark):
    rows = [(f"r{i}", i, float(i % 7), 100 if i == 5 else 1, i * i) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, a long, b double, c long, d long")
    own = sorted(map(tuple, an.column_zscores(df, None, ["name"]).collect()))
    assert own == sorted(map(tuple, an.column_zscores(df, ["a", "b", "c"], ["name"]).collect())) and {r[1] for r in own} == {"c"}
    with pytest.raises(ValueError):
        an.column_zscores(df.select("name"), None, ["name"])


def test_errors(spark):
    with pytest.raises(ValueError):
        an.anomalies_of_table(spark.createDataFrame([("a",)], "s string"), ["s"])
    with pytest.raises(ValueError):
        an.anomalies_of_table(spark.createDataFrame([(1, 2.0)], "i long, v double"), ["i"], "v")
