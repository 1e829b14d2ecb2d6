"""Forecasts of order totals per priority, event values per type, and daily totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import forecast as fc
from tablelens.plans.registry import query, table

KEY = ["o_orderpriority"]


def _orders(spark, sf, grain: str):
    return fc.period_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", KEY, grain)


def series_sql(grain: str) -> str:
    return f"""s AS (SELECT o_orderpriority, ts, value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) - 1 AS idx,
               count(*) OVER (PARTITION BY o_orderpriority) AS n
        FROM (SELECT o_orderpriority, CAST(date_trunc('{grain}', o_orderdate) AS DATE) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2))"""


_STEPS = "(SELECT unnest(generate_series(1, 5)) AS step)"
_FIT = "round(level, 2) AS level, round(trend, 2) AS trend, round(spread, 2) AS spread, round(mae, 2) AS mae, round(mape, 4) AS mape, round(rmse, 2) AS rmse"
_ERR = """max(n) AS n, coalesce(stddev_samp(r), 0) AS spread, avg(abs(r)) AS mae, avg(CASE WHEN value <> 0 THEN abs(r / value) * 100 ELSE 0 END) AS mape, sqrt(avg(r * r)) AS rmse"""

_MA = f"""{series_sql('day')}, w AS (SELECT *, least(floor(n / 3), 10) AS w, avg(value) OVER (PARTITION BY o_orderpriority ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ma FROM s),
    m AS (SELECT *, value - ma AS r FROM w WHERE idx >= 9),
    fit AS (SELECT o_orderpriority, {_ERR}, max_by(ma, idx) AS level, 0.0::DOUBLE AS trend FROM m GROUP BY 1)"""


def smooth_sql(alpha: float, beta: float, trend: str) -> str:
    """Level and trend by a recursive query over the weekly index."""
    return f"""RECURSIVE {series_sql('week')}, f AS (SELECT a.*, {trend} AS t0 FROM s a JOIN s b ON a.o_orderpriority = b.o_orderpriority AND b.idx = 1 WHERE a.idx = 0),
    rec AS (SELECT o_orderpriority, idx, n, value, value AS level, t0::DOUBLE AS trend, 0.0::DOUBLE AS r FROM f
      UNION ALL SELECT s.o_orderpriority, s.idx, s.n, s.value, {alpha} * s.value + {1 - alpha} * (rec.level + rec.trend),
        {beta} * ({alpha} * s.value + {1 - alpha} * (rec.level + rec.trend) - rec.level) + {1 - beta} * rec.trend,
        s.value - ({alpha} * s.value + {1 - alpha} * (rec.level + rec.trend) + rec.trend)
      FROM rec JOIN s ON s.o_orderpriority = rec.o_orderpriority AND s.idx = rec.idx + 1),
    fit AS (SELECT o_orderpriority, {_ERR}, max_by(level, idx) AS level, max_by(trend, idx) AS trend FROM rec GROUP BY 1)""".replace("0.30000000000000004", "0.3")


_SES = smooth_sql(0.3, 0.0, "0.0")
_HOLT = smooth_sql(0.3, 0.1, "b.value - a.value")

_HW = f"""RECURSIVE {series_sql('month')}, fac AS (SELECT o_orderpriority, list(f ORDER BY ph) AS fs, avg(f) AS m FROM
      (SELECT o_orderpriority, idx % 12 AS ph, avg(value) AS f FROM s GROUP BY 1, 2) GROUP BY 1),
    ini AS (SELECT o_orderpriority, list_transform(fs, lambda x: x / m) AS se FROM fac),
    rec AS (SELECT s.o_orderpriority, s.idx, s.n, s.value, s.value / se[1] AS level, (b.value / se[1] - s.value / se[1]) / 12 AS trend, se
            FROM s JOIN ini USING (o_orderpriority) JOIN s b ON b.o_orderpriority = s.o_orderpriority AND b.idx = 12 WHERE s.idx = 0
      UNION ALL SELECT o_orderpriority, idx, n, value, nl, 0.1 * (nl - level) + 0.9 * trend,
            list_transform(se, lambda x, j: CASE WHEN j - 1 = idx % 12 THEN 0.1 * (value / nl) + 0.9 * x ELSE x END)
        FROM (SELECT s.o_orderpriority, s.idx, s.n, s.value, rec.level, rec.trend, rec.se,
                     0.2 * (s.value / rec.se[s.idx % 12 + 1]) + 0.8 * (rec.level + rec.trend) AS nl
              FROM rec JOIN s ON s.o_orderpriority = rec.o_orderpriority AND s.idx = rec.idx + 1)),
    fin AS (SELECT o_orderpriority, max_by(se, idx) AS fse, max_by(level, idx) AS level, max_by(trend, idx) AS trend FROM rec GROUP BY 1),
    res AS (SELECT rec.*, value - (rec.level + rec.trend) * fse[idx % 12 + 1] AS r FROM rec JOIN fin USING (o_orderpriority)),
    fit AS (SELECT * FROM (SELECT o_orderpriority, {_ERR} FROM res GROUP BY 1) JOIN fin USING (o_orderpriority))"""


def _fit(df):
    two = {c: F.round(c, 2) for c in ("level", "trend", "spread", "mae", "rmse")}
    return df.withColumns({**two, "mape": F.round("mape", 4)}).select(*KEY, "n", "level", "trend", "spread", "mae", "mape", "rmse")


def _steps(df):
    return df.select(*KEY, "step", *[F.round(c, 2).alias(c) for c in ("value", "lower", "upper")])


def steps_sql(widen: float, season: str = "1") -> str:
    v = f"(level + step * trend) * {season}"
    h = f"1.96 * spread * sqrt(1 + (step - 1) * {widen})"
    return f"SELECT o_orderpriority, CAST(step AS INT) AS step, round({v}, 2) AS value, round({v} - {h}, 2) AS lower, round({v} + {h}, 2) AS upper FROM fit, {_STEPS}"


@query("moving_average_fit", "F1 F8", f"WITH {_MA} SELECT o_orderpriority, n, {_FIT} FROM fit")
def moving_average_fit(spark, sf):
    return _fit(fc.moving_average(_orders(spark, sf, "day"), KEY))


@query("moving_average_forecast", "F1", f"WITH {_MA} {steps_sql(0.0)}")
def moving_average_forecast(spark, sf):
    return _steps(fc.project(fc.moving_average(_orders(spark, sf, "day"), KEY), keys=KEY))


@query("single_smoothing_fit", "F2 F8", f"WITH {_SES} SELECT o_orderpriority, n, {_FIT} FROM fit")
def single_smoothing_fit(spark, sf):
    return _fit(fc.single_smoothing(_orders(spark, sf, "week"), KEY))


@query("double_smoothing_fit", "F3 F8", f"WITH {_HOLT} SELECT o_orderpriority, n, {_FIT} FROM fit")
def double_smoothing_fit(spark, sf):
    return _fit(fc.double_smoothing(_orders(spark, sf, "week"), KEY))


@query("double_smoothing_forecast", "F3", f"WITH {_HOLT} {steps_sql(0.1)}")
def double_smoothing_forecast(spark, sf):
    return _steps(fc.project(fc.double_smoothing(_orders(spark, sf, "week"), KEY), keys=KEY))


@query("triple_smoothing_fit", "F4 F8", f"WITH {_HW} SELECT o_orderpriority, n, {_FIT} FROM fit")
def triple_smoothing_fit(spark, sf):
    return _fit(fc.triple_smoothing(_orders(spark, sf, "month"), 12, KEY))


@query("triple_smoothing_forecast", "F4", f"WITH {_HW} {steps_sql(0.05, 'fse[CAST((n + step - 1) % 12 AS INT) + 1]')}")
def triple_smoothing_forecast(spark, sf):
    return _steps(fc.project(fc.triple_smoothing(_orders(spark, sf, "month"), 12, KEY), keys=KEY))


_TREND = f"""{series_sql('month')}, g AS (SELECT o_orderpriority, regr_slope(value, idx) AS slope, regr_r2(value, idx) AS r2, avg(value) AS m, count(*) AS n FROM s GROUP BY 1)"""


@query(
    "trend_direction",
    "F5",
    f"""WITH {_TREND} SELECT o_orderpriority, n, CASE WHEN slope / m > 0.01 THEN 'up' WHEN slope / m < -0.01 THEN 'down' ELSE 'stable' END AS direction,
        round(abs(r2), 6) AS strength, round(slope, 2) AS slope FROM g""",
)
def trend_direction(spark, sf):
    return fc.trends(_orders(spark, sf, "month"), KEY).withColumns({"strength": F.round("strength", 6), "slope": F.round("slope", 2)})


_ACF = f"""{series_sql('day')}, st AS (SELECT o_orderpriority, avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM s GROUP BY 1),
    acf AS (SELECT a.o_orderpriority, a.idx - b.idx AS lag, sum((a.value - m) * (b.value - m)) / (any_value(st.n) * any_value(v)) AS acf
            FROM s a JOIN s b ON a.o_orderpriority = b.o_orderpriority AND b.idx BETWEEN a.idx - 52 AND a.idx - 1
            JOIN st ON st.o_orderpriority = a.o_orderpriority GROUP BY 1, 2)"""


@query("autocorrelations", "F6", f"WITH {_ACF} SELECT o_orderpriority, CAST(lag AS INT) AS lag, round(acf, 6) AS acf FROM acf")
def autocorrelations(spark, sf):
    return fc.autocorrelations(_orders(spark, sf, "day"), KEY).select(*KEY, "lag", F.round("acf", 6).alias("acf"))


@query(
    "seasonality",
    "F6",
    f"""WITH {_ACF}, best AS (SELECT o_orderpriority, acf, lag, row_number() OVER (PARTITION BY o_orderpriority ORDER BY acf DESC, lag) AS rn FROM acf WHERE lag >= 2 AND acf > 0.3)
        SELECT st.o_orderpriority, st.n, lag IS NOT NULL AS detected, CAST(coalesce(lag, 0) AS INT) AS period, round(coalesce(acf, 0), 6) AS strength
        FROM st LEFT JOIN best ON st.o_orderpriority = best.o_orderpriority AND rn = 1""",
)
def seasonality(spark, sf):
    return fc.seasonality(_orders(spark, sf, "day"), KEY).withColumn("strength", F.round("strength", 6))


@query("automatic_forecast", "F7")
def automatic_forecast(spark, sf):
    return fc.project(fc.auto_fit(_orders(spark, sf, "day"), KEY), keys=KEY)


@query(
    "forecast_report",
    "F9",
    f"""WITH {_HOLT} SELECT o_orderpriority, n, 5 AS horizon, round(mae, 2) AS mae, round(mape, 4) AS mape, round(rmse, 2) AS rmse,
        CASE WHEN mape < 10 THEN 'high' WHEN mape < 20 THEN 'medium' ELSE 'low' END AS accuracy,
        CASE WHEN abs(4 * trend) > 0.01 * abs(level + trend) THEN round(4 * trend / (level + trend) * 100, 4) END AS change_pct FROM fit""",
)
def forecast_report(spark, sf):
    out = fc.forecast_report(fc.double_smoothing(_orders(spark, sf, "week"), KEY), keys=KEY).drop("method")
    return out.withColumns({"mae": F.round("mae", 2), "mape": F.round("mape", 4), "rmse": F.round("rmse", 2), "change_pct": F.round("change_pct", 4)})


@query(
    "daily_forecast",
    "F10",
    f"""WITH {series_sql('day')}, g AS (SELECT o_orderpriority, max(n) AS n, avg(value) FILTER (WHERE idx >= n - 7) AS avg7, avg(value) FILTER (WHERE idx < floor(n / 2)) AS a,
          avg(value) FILTER (WHERE idx >= floor(n / 2)) AS b, max(ts) AS last FROM s GROUP BY 1),
        sd AS (SELECT s.o_orderpriority, sqrt(avg((value - avg7) * (value - avg7))) AS sd FROM s JOIN g USING (o_orderpriority) GROUP BY 1)
        SELECT o_orderpriority, CAST(last + CAST(step AS INT) AS DATE) AS ts, floor((avg7 + (b - a) / (n / 2) * step) * 100 + 0.5) / 100 AS value, 'forecast' AS kind,
               floor(sd * 100 + 0.5) / 100 AS spread FROM g JOIN sd USING (o_orderpriority), (SELECT unnest(generate_series(1, 7)) AS step)
        UNION ALL SELECT o_orderpriority, ts, round(value, 2), 'history', NULL FROM s WHERE idx >= n - 30""",
)
def daily_forecast(spark, sf):
    out = fc.daily_forecast(_orders(spark, sf, "day"), keys=KEY)
    return out.withColumn("value", F.when(F.col("kind") == "history", F.round("value", 2)).otherwise(F.col("value")))


@query("table_forecast", "F11")
def table_forecast(spark, sf):
    return fc.forecast_table(table(spark, sf, "events"), ["event_id"], "value", "ts")
