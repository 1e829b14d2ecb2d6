import math
import statistics

import pytest
from pyspark.sql import functions as F

from tablelens.operators import forecast as fc

VALUES = {
    "trend": [10.0 + 2 * i + (i * 7 % 5) for i in range(41)],
    "season": [100.0 + 20 * math.sin(2 * math.pi * i / 7) + i % 2 for i in range(63)],
    "zeros": [float(i % 3) for i in range(13)],
    "short": [4.0, 6.0, 5.0],
}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, i, v) for k, vs in VALUES.items() for i, v in enumerate(vs)]
    return fc.ordered_series(spark.createDataFrame(rows, "k string, t long, value double").repartition(5), "value", ["t"], ["k"])


def accuracy(values, res):
    return {
        "spread": statistics.stdev(res),
        "mae": statistics.fmean(map(abs, res)),
        "mape": statistics.fmean(abs(r / v) * 100 if v else 0.0 for r, v in zip(res, values)),
        "rmse": math.sqrt(statistics.fmean(r * r for r in res)),
    }


def holt(values, alpha, beta, trend):
    level, res = values[0], [0.0]
    for v in values[1:]:
        new = alpha * v + (1 - alpha) * (level + trend)
        res.append(v - (new + trend))
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    return {"level": level, "trend": trend, **accuracy(values, res)}


def check(fits, want):
    got = {r["k"]: r for r in fits.collect()}
    assert set(got) == set(want)
    for k, fields in want.items():
        for name, value in fields.items():
            assert got[k][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (k, name)


@pytest.mark.parametrize("size", [3, 8, 4096])
def test_single_smoothing_in_blocks(series, size):
    check(fc.single_smoothing(series, ["k"], size=size), {k: holt(v, 0.3, 0.0, 0.0) for k, v in VALUES.items()})


@pytest.mark.parametrize("size", [3, 4096])
def test_double_smoothing_in_blocks(series, size):
    check(fc.double_smoothing(series, ["k"], size=size), {k: holt(v, 0.3, 0.1, v[1] - v[0]) for k, v in VALUES.items()})


def test_chains_of_blocks_of_blocks(series, monkeypatch):
    monkeypatch.setattr(fc, "BLOCK", 2)
    check(fc.double_smoothing(series, ["k"], size=3), {k: holt(v, 0.3, 0.1, v[1] - v[0]) for k, v in VALUES.items()})


def test_single_smoothing_known_value(spark):
    s = fc.ordered_series(spark.createDataFrame(list(enumerate([3.0, 5.0, 9.0, 4.0])), "t long, value double"), "value", ["t"])
    assert fc.single_smoothing(s).first()["level"] == pytest.approx(4.854)


def test_moving_average(series):
    want = {}
    for k, v in VALUES.items():
        w = min(len(v) // 3, 10)
        ma = [statistics.fmean(v[i - w + 1: i + 1]) for i in range(w - 1, len(v))]
        res = [x - m for x, m in zip(v[w - 1:], ma)]
        acc = accuracy(v[w - 1:], res)
        want[k] = {"level": ma[-1], **acc}
    check(fc.moving_average(series, ["k"]), want)


def winters(values, p, alpha=0.2, beta=0.1, gamma=0.1):
    fac = [statistics.fmean(values[i::p]) for i in range(p)]
    mean = statistics.fmean(fac)
    seasons = [f / mean for f in fac]
    level = values[0] / seasons[0]
    trend = (values[p] / seasons[0] - level) / p
    levels, trends = [level], [trend]
    for i, v in enumerate(values[1:], 1):
        new = alpha * v / seasons[i % p] + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
        seasons[i % p] = gamma * v / level + (1 - gamma) * seasons[i % p]
        levels.append(level)
        trends.append(trend)
    res = [v - (l + t) * seasons[i % p] for i, (v, l, t) in enumerate(zip(values, levels, trends))]
    ahead = [(level + (i + 1) * trend) * seasons[(len(values) + i) % p] for i in range(5)]
    return {"level": level, "trend": trend, **accuracy(values, res)}, ahead


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_triple_smoothing_carries_its_state(spark, series, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        fits = fc.materialize(fc.triple_smoothing(series, 7, ["k"]))
    finally:
        spark.conf.set(name, before)
    want = {k: winters(v, 7)[0] for k, v in VALUES.items() if k in ("trend", "season")}
    check(fits, want)
    steps = {r["step"]: r["value"] for r in fc.project(fits, 5, keys=["k"]).where("k = 'season'").collect()}
    assert [steps[i] for i in range(1, 6)] == pytest.approx(winters(VALUES["season"], 7)[1])


def test_triple_smoothing_of_a_long_series(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.col("id").alias("idx"), (100 + 10 * (F.col("id") % 4) + F.col("id") % 7).cast("double").alias("value"))
    got = fc.triple_smoothing(rows, 4).first()
    want = winters([100.0 + 10 * (i % 4) + i % 7 for i in range(n)], 4)[0]
    assert got["n"] == n
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=1e-7, abs=1e-6), name


def test_triple_smoothing_moves_blocks_not_points(spark):
    # a row per point made the one task of a long series 16 microseconds a point
    n, p = 10_000, 4
    values = [100.0 + 10 * (i % p) + i % 7 for i in range(n)]
    rows = spark.createDataFrame([(k, i, v) for k in ("a", "b") for i, v in enumerate(values)], "k string, idx long, value double")
    factors = [statistics.fmean(values[i::p]) for i in range(p)]
    seasons = [f / statistics.fmean(factors) for f in factors]
    level = values[0] / seasons[0]
    trend = (values[p] / seasons[0] - level) / p
    start = spark.createDataFrame([("a", level, trend, seasons)], "k string, level double, trend double, seasons array<double>")
    moved = fc.materialize(fc._carried(rows, start, ["k"], (fc.HW_ALPHA, fc.HW_BETA, fc.HW_GAMMA)))
    assert moved.count() == -(-n // fc.CARRIED) + 1
    assert [r["k"] for r in moved.select("k").distinct().collect()] == ["a"]
    blocks = moved.where("idx >= 0").orderBy("idx").collect()
    assert [v for b in blocks for v in b["vs"]] == values and all(len(b["bases"]) == len(b["vs"]) for b in blocks)
    last = moved.where("idx < 0").first()
    assert blocks[-1]["bases"][-1] == last["level"] + last["trend"]
    assert last["level"] == pytest.approx(winters(values, p)[0]["level"])


def test_triple_smoothing_without_enough_points(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(5)], "idx long, value double")
    assert fc.triple_smoothing(rows, 4).count() == 0
    assert fc.triple_smoothing(rows.limit(0), 4).count() == 0


def test_triple_smoothing_keeps_a_null_key_apart(spark):
    rows = [(k, i, 10.0 + i % 3 + (k or 0)) for k in (None, 1) for i in range(12)]
    got = fc.triple_smoothing(spark.createDataFrame(rows, "k long, idx long, value double"), 3, ["k"]).collect()
    assert {r["k"]: r["level"] for r in got} == pytest.approx({k: winters([10.0 + i % 3 + (k or 0) for i in range(12)], 3)[0]["level"] for k in (None, 1)})


def test_seasonality_and_trend(series):
    got = {r["k"]: (r["detected"], r["period"]) for r in fc.seasonality(series, ["k"]).collect()}
    assert got["season"] == (True, 14) or got["season"] == (True, 7)
    assert got["short"] == (False, 0)
    direction = {r["k"]: r["direction"] for r in fc.trends(series, ["k"]).collect()}
    assert direction["trend"] == "up" and direction["zeros"] in ("stable", "up", "down")


def test_autocorrelation_over_block_edges(series, monkeypatch):
    import functools

    monkeypatch.setattr(fc, "series_blocks", functools.partial(fc.series_blocks, size=5))
    got = {r["lag"]: r["acf"] for r in fc.autocorrelations(series, ["k"]).where("k = 'season'").collect()}
    v = VALUES["season"]
    m, n = statistics.fmean(v), len(v)
    var = statistics.pvariance(v)
    want = {lag: sum((v[i] - m) * (v[i - lag] - m) for i in range(lag, n)) / (n * var) for lag in range(1, n // 3 + 1)}
    assert got == pytest.approx(want)


def test_automatic_choice(series):
    fits = {r["k"]: r for r in fc.auto_fit(series, ["k"]).collect()}
    assert fits["season"]["method"] == "triple_smoothing"
    assert fits["trend"]["method"] in ("triple_smoothing", "double_smoothing")
    assert fits["short"]["method"] == "double_smoothing"
    # seasonal, but one phase is always 0: the simpler models are compared
    tried = {}
    for model in (fc.moving_average, fc.single_smoothing, fc.double_smoothing):
        row = model(series.where("k = 'zeros'"), ["k"]).first()
        tried[row["method"]] = row["mape"]
    assert fits["zeros"]["method"] == min(tried, key=tried.get)


def test_unknown_confidence_level(series):
    with pytest.raises(ValueError):
        fc.project(fc.single_smoothing(series, ["k"]), level=0.5, keys=["k"])
