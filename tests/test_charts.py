import pytest
from pyspark.sql import functions as F

from tablelens.operators import charts as ch


def kinds(spark, columns, rows):
    df = spark.createDataFrame(rows, columns)
    return [(r["chart"], r["x"], r["y"]) for r in ch.recommend_charts(ch.result_profile(df)).collect()]


def test_recommendations(spark):
    assert kinds(spark, "v double", [(3.0,)]) == [("gauge", "v", None)]
    assert kinds(spark, "name string", [("a",), ("b",)]) == [("bar", "name", None)]
    got = kinds(spark, "d string, open double, high double, low double, close double", [("2024/01/02", 1.0, 2.0, 0.5, 1.5), ("2024/01/03", 1.5, 2.0, 1.0, 1.0)])
    assert [g[0] for g in got] == ["candlestick", "line", "scatter", "radar"]
    got = kinds(spark, "source string, target string, n long", [(f"a{i}", f"b{i % 3}", i) for i in range(30)])
    assert [g[0] for g in got] == ["bar", "sankey", "pie", "heatmap"] and got[0][1] == "target"
    got = kinds(spark, "parent_id string, stage string, n long", [("x", f"s{i % 9}", i) for i in range(30)])
    assert [g[0] for g in got] == ["bar", "funnel", "treemap", "heatmap"]


@pytest.mark.parametrize("text,date", [("2024-01-05x", True), ("05/01/2024", True), ("2024年1月5日", True), ("01-Jan-2024", True), ("Jan 1, 2024", True), ("1.1.2024", False), ("", False)])
def test_date_text(spark, text, date):
    assert spark.createDataFrame([(text,)], "t string").select(ch.looks_like_date(F.col("t")).alias("d")).first()["d"] is date


def test_inferred_chart(spark):
    make = lambda schema, rows: ch.infer_chart(spark.createDataFrame(rows, schema))
    assert make("a string", [("x",)]) == "bar"
    assert make("a string, b long", [("2024-01-01", 1)]) == "line"
    assert make("a string, b long", [("x", i) for i in range(8)]) == "pie"
    assert make("a string, b long", [("x", i) for i in range(9)]) == "bar"
    assert make("a string, b string", [("x", "y")]) == "bar"


def test_box_plot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in values] + [(None, 5.0)], "g string, v double")
    rows = {r["group"]: r for r in ch.box_plot(df, "g", "v").collect()}
    b = rows["g"]
    assert (b["lower"], b["q1"], b["median"], b["q3"], b["upper"], b["n"]) == (1.0, 3.0, 5.0, 7.0, 13.0, 8)
    assert rows[None]["n"] == 1
    assert [r["value"] for r in ch.box_outliers(df, "g", "v").collect()] == [100.0]


def test_funnel_and_treemap(spark):
    df = spark.createDataFrame([("view", 100), ("cart", 40), ("buy", 10), ("odd", 0)], "s string, n long")
    got = [(r["stage"], r["rate_pct"], r["share_pct"]) for r in ch.funnel(df, "s", "n").orderBy("step").collect()]
    assert got == [("view", None, 100.0), ("cart", 40.0, 40.0), ("buy", 25.0, 10.0), ("odd", 0.0, 0.0)]
    up = [(r["stage"], r["rate_pct"]) for r in ch.funnel(df, "s", "n", ascending=True).orderBy("step").collect()]
    assert up == [("odd", None), ("buy", None), ("cart", 400.0), ("view", 250.0)]
    given = spark.createDataFrame([("b", 40, 2), ("a", 10, 1), ("c", 0, 3), ("d", 5, 4)], "s string, n long, i int")
    as_is = [(r["stage"], r["rate_pct"], r["share_pct"]) for r in ch.funnel(given, "s", "n", order_by="i").orderBy("step").collect()]
    assert as_is == [("a", None, 100.0), ("b", 400.0, 400.0), ("c", 0.0, 0.0), ("d", None, 50.0)]
    s = ch.treemap_summary(ch.treemap(df, "s", "n")).first()
    assert (s["total"], s["largest"], s["top_pct"]) == (150.0, "view", 100.0)


def test_heatmap_takes_first_seen_order(spark):
    df = spark.createDataFrame([(0, "z", "q", 1.0), (1, "a", "p", 5.0), (2, "z", "p", 2.0), (3, "a", "p", 4.0)], "i long, x string, y string, v double")
    got = {(r["x"], r["y"]): (r["x_index"], r["y_index"], r["value"], r["mark"]) for r in ch.heatmap_cells(df, "x", "y", "v", "i").collect()}
    assert got == {("z", "q"): (0, 0, 1.0, "min"), ("a", "p"): (1, 1, 9.0, "max"), ("z", "p"): (0, 1, 2.0, None)}


def test_radar_and_gauge(spark):
    df = spark.createDataFrame([("s", 1.0, 5.0, 5.0), ("t", 10.0, 1.0, 1.0)], "n string, a double, b double, c double")
    axes = ch.radar_axes(df, "n", ["a", "b", "c"])
    assert {(r["name"], r["dimension"]): r["axis_max"] for r in axes.collect()}["s", "a"] == 12.0
    assert {r["name"]: (r["strongest"], r["weakest"]) for r in ch.radar_extremes(axes).collect()} == {"s": ("b", "a"), "t": ("a", "b")}
    bands = [ch.gauge(spark.createDataFrame([(v,)], "v double"), "v").first()["band"] for v in (30.0, 30.1, 70.0, 71.0)]
    assert bands == ["low", "medium", "medium", "high"]
