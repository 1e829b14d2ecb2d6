"""Chart tables over orders, lines, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import charts
from tablelens.plans.registry import query, table


def _dated_orders(spark, sf):
    return table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey")


_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {pos} AS position, '{kind}' AS kind, count(*) AS "rows", count(DISTINCT {c}) AS "distinct",
        {f'min({c})::DOUBLE' if kind == 'number' else 'NULL::DOUBLE'} AS min, {f'max({c})::DOUBLE' if kind == 'number' else 'NULL::DOUBLE'} AS max,
        {f'round(avg({c}), 4)' if kind == 'number' else 'NULL::DOUBLE'} AS mean, {'true' if kind == 'date' else 'false'} AS is_time_series,
        {f'count(DISTINCT {c}) BETWEEN 2 AND 10' if kind == 'string' else 'false'} AS multi_series, false AS hierarchical
        FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, * FROM orders)"""
    for pos, (c, kind) in enumerate({"day": "date", "o_orderpriority": "string", "o_orderstatus": "string", "o_totalprice": "number", "o_custkey": "number"}.items())
)


@query("chart_result_profile", "V1", _PROFILE)
def chart_result_profile(spark, sf):
    out = charts.result_profile(_dated_orders(spark, sf)).withColumn("mean", F.round("mean", 4))
    return out.select("column", "position", "kind", "rows", "distinct", "min", "max", "mean", "is_time_series", "multi_series", "hierarchical")


@query(
    "chart_recommendations",
    "V2",
    """SELECT * FROM (VALUES ('line', 0.9::DOUBLE, 'day', 'o_totalprice', 1), ('bar', 0.85::DOUBLE, 'o_orderpriority', 'o_totalprice', 2),
        ('pie', 0.75::DOUBLE, 'o_orderpriority', 'o_totalprice', 3), ('scatter', 0.8::DOUBLE, 'o_totalprice', 'o_custkey', 4),
        ('heatmap', 0.7::DOUBLE, 'o_orderpriority', 'o_orderstatus', 5)) v(chart, confidence, x, y, rule)
       WHERE (SELECT count(DISTINCT o_orderpriority) BETWEEN 2 AND 8 FROM orders)""",
)
def chart_recommendations(spark, sf):
    return charts.recommend_charts(charts.result_profile(_dated_orders(spark, sf)))


@query("chart_recommendations_short", "V2")
def chart_recommendations_short(spark, sf):
    bars = charts.candlesticks(table(spark, sf, "events"), "ts", "value", "event_id", ["event_type"])
    return charts.recommend_charts(charts.result_profile(bars), keep=5)


@query(
    "chart_inference",
    "V3",
    """SELECT 'monthly' AS result, 'line' AS chart UNION ALL SELECT 'per_priority', CASE WHEN count(DISTINCT o_orderpriority) <= 8 THEN 'pie' ELSE 'bar' END FROM orders
       UNION ALL SELECT 'per_brand', CASE WHEN count(DISTINCT p_brand) <= 8 THEN 'pie' ELSE 'bar' END FROM part""",
)
def chart_inference(spark, sf):
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    monthly = orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    priority = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    brand = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    rows = [(name, charts.infer_chart(df)) for name, df in (("monthly", monthly), ("per_priority", priority), ("per_brand", brand))]
    return spark.createDataFrame(rows, "result string, chart string")


@query(
    "chart_series",
    "V4",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS x, round(sum(o_totalprice), 2) AS total, CAST(count(*) AS DOUBLE) AS n
       FROM orders GROUP BY 1 ORDER BY 1""",
)
def chart_series(spark, sf):
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    monthly = table(spark, sf, "orders").groupBy(month).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    return charts.series_points(monthly, "month", ["total", "n"], ["month"])


@query(
    "chart_pie",
    "V5",
    """SELECT p_brand AS name, round(sum(p_retailprice), 2) AS value, round(sum(p_retailprice) * 100 / (SELECT sum(p_retailprice) FROM part), 4) AS pct
       FROM part GROUP BY p_brand ORDER BY round(sum(p_retailprice), 2) DESC, p_brand""",
)
def chart_pie(spark, sf):
    out = charts.pie_slices(table(spark, sf, "part"), "p_brand", "p_retailprice")
    return out.withColumns({"value": F.round("value", 2), "pct": F.round("pct", 4)})


@query("chart_scatter", "V6", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def chart_scatter(spark, sf):
    return charts.scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "chart_heatmap",
    "V7",
    """WITH c AS (SELECT o_orderpriority AS x, o_orderstatus AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
        xi AS (SELECT o_orderpriority AS x, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS x_index FROM orders GROUP BY 1),
        yi AS (SELECT o_orderstatus AS y, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS y_index FROM orders GROUP BY 1)
       SELECT x, y, x_index, y_index, round(v, 2) AS value, CASE WHEN v = (SELECT max(v) FROM c) THEN 'max' WHEN v = (SELECT min(v) FROM c) THEN 'min' END AS mark
       FROM c JOIN xi USING (x) JOIN yi USING (y)""",
)
def chart_heatmap(spark, sf):
    # summed in cents, so that equal cells stay equal whatever the order of the additions
    orders = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return charts.heatmap_cells(orders, "o_orderpriority", "o_orderstatus", "cents", "o_orderkey").withColumn("value", F.round(F.col("value") / 100, 2))


_DIMS = ["quantity", "discount", "tax"]
_RADAR = """r AS (SELECT l_returnflag AS name, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
    l AS (SELECT name, unnest([1, 2, 3]) AS i, unnest(['quantity', 'discount', 'tax']) AS dimension, unnest([quantity, discount, tax]) AS value FROM r)"""


def _radar(spark, sf):
    means = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return charts.radar_axes(means, "l_returnflag", _DIMS)


@query("chart_radar", "V8", f"WITH {_RADAR} SELECT name, dimension, round(value, 6) AS value, round(1.2 * max(value) OVER (PARTITION BY dimension), 6) AS axis_max FROM l")
def chart_radar(spark, sf):
    return _radar(spark, sf).select("name", "dimension", F.round("value", 6).alias("value"), F.round("axis_max", 6).alias("axis_max"))


@query("chart_radar_extremes", "V8", f"WITH {_RADAR} SELECT name, arg_max(dimension, value) AS strongest, arg_min(dimension, value) AS weakest FROM l GROUP BY name")
def chart_radar_extremes(spark, sf):
    return charts.radar_extremes(_radar(spark, sf))


@query(
    "chart_funnel",
    "V9",
    """WITH s AS (SELECT event_type AS stage, count(*) AS value FROM events GROUP BY 1)
       SELECT stage, value, CAST(row_number() OVER o AS INT) AS step, round(value * 100.0::DOUBLE / lag(value) OVER o, 4) AS rate_pct,
              round(value * 100.0::DOUBLE / first_value(value) OVER o, 4) AS share_pct FROM s WINDOW o AS (ORDER BY value DESC, stage)""",
)
def chart_funnel(spark, sf):
    stages = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("value"))
    return charts.funnel(stages, "event_type", "value").withColumns({"rate_pct": F.round("rate_pct", 4), "share_pct": F.round("share_pct", 4)})


@query(
    "chart_funnel_as_given",
    "V9",
    """WITH s AS (SELECT event_type AS stage, count(*) AS value, min(event_id) AS first_id FROM events GROUP BY 1)
       SELECT stage, value, CAST(row_number() OVER o AS INT) AS step, round(value * 100.0::DOUBLE / lag(value) OVER o, 4) AS rate_pct,
              round(value * 100.0::DOUBLE / first_value(value) OVER o, 4) AS share_pct FROM s WINDOW o AS (ORDER BY first_id, stage)""",
)
def chart_funnel_as_given(spark, sf):
    stages = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("value"), F.min("event_id").alias("first_id"))
    found = charts.funnel(stages, "event_type", "value", order_by="first_id")
    return found.withColumns({"rate_pct": F.round("rate_pct", 4), "share_pct": F.round("share_pct", 4)})


_TREE = "t AS (SELECT p_type AS name, sum(p_retailprice) AS v FROM part GROUP BY 1)"


@query("chart_treemap", "V10", f"WITH {_TREE} SELECT name, round(v, 2) AS value, round(v * 100 / (SELECT sum(v) FROM t), 4) AS pct FROM t")
def chart_treemap(spark, sf):
    out = charts.treemap(table(spark, sf, "part"), "p_type", "p_retailprice")
    return out.withColumns({"value": F.round("value", 2), "pct": F.round("pct", 4)})


@query(
    "chart_treemap_summary",
    "V10",
    f"""WITH {_TREE}, b AS (SELECT * FROM t ORDER BY v DESC LIMIT 3) SELECT round((SELECT sum(v) FROM t), 2) AS total, arg_max(name, v) AS largest,
        round(max(v), 2) AS largest_value, round(sum(v) * 100 / (SELECT sum(v) FROM t), 4) AS top_pct FROM b""",
)
def chart_treemap_summary(spark, sf):
    out = charts.treemap_summary(charts.treemap(table(spark, sf, "part"), "p_type", "p_retailprice"))
    return out.withColumns({"total": F.round("total", 2), "largest_value": F.round("largest_value", 2), "top_pct": F.round("top_pct", 4)})


@query("chart_sankey_nodes", "V11", "SELECT o_orderpriority AS name FROM orders UNION SELECT o_orderstatus FROM orders")
def chart_sankey_nodes(spark, sf):
    return charts.sankey_nodes(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("chart_sankey_links", "V11", "SELECT o_orderpriority AS source, o_orderstatus AS target, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2")
def chart_sankey_links(spark, sf):
    links = charts.sankey_links(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    return links.withColumn("value", F.round("value", 2))


@query(
    "chart_gauge",
    "V12",
    """SELECT round(v, 4) AS value, 100.0::DOUBLE AS max, CASE WHEN v <= 30 THEN 'low' WHEN v <= 70 THEN 'medium' ELSE 'high' END AS band
       FROM (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS v FROM orders)""",
)
def chart_gauge(spark, sf):
    share = table(spark, sf, "orders").agg((100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("v"))
    return charts.gauge(share, "v").withColumn("value", F.round("value", 4))


_BOX = """s AS (SELECT event_type AS g, list(value ORDER BY value) AS l, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM events WHERE value IS NOT NULL GROUP BY 1),
    q AS (SELECT *, l[CAST(floor(n * 0.25) AS BIGINT) + 1] AS q1, l[CAST(floor(n * 0.5) AS BIGINT) + 1] AS med, l[CAST(floor(n * 0.75) AS BIGINT) + 1] AS q3 FROM s),
    b AS (SELECT g, greatest(l[1], q1 - 1.5 * (q3 - q1)) AS lower, q1, med, q3, least(l[n], q3 + 1.5 * (q3 - q1)) AS upper, mean, sd, n FROM q)"""


@query(
    "chart_box_plot",
    "V13",
    f"""WITH {_BOX} SELECT g AS "group", round(lower, 4) AS lower, q1, med AS median, q3, round(upper, 4) AS upper, round(mean, 4) AS mean, round(sd, 4) AS sd, n FROM b""",
)
def chart_box_plot(spark, sf):
    out = charts.box_plot(table(spark, sf, "events"), "event_type", "value")
    return out.withColumns({c: F.round(c, 4) for c in ("lower", "upper", "mean", "sd")})


@query("chart_box_outliers", "V13", f"""WITH {_BOX} SELECT g AS "group", value, event_id FROM events JOIN b ON g = event_type WHERE value < lower OR value > upper""")
def chart_box_outliers(spark, sf):
    return charts.box_outliers(table(spark, sf, "events"), "event_type", "value", ["event_id"])


@query(
    "chart_candlesticks",
    "V14",
    """SELECT event_type, CAST(ts AS DATE) AS period, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close, min(value) AS low, max(value) AS high,
              count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def chart_candlesticks(spark, sf):
    return charts.candlesticks(table(spark, sf, "events"), "ts", "value", "event_id", ["event_type"])
