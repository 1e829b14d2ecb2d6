"""Outliers in event values, alone and per event type, and in several line columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import anomaly
from tablelens.plans.registry import query, table

_E = """WITH e AS (SELECT event_type, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events WHERE value IS NOT NULL),
        k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events WHERE value IS NOT NULL)"""
_Z = """z AS (SELECT idx, value, abs(value - m) / sd AS score FROM e, (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM e) WHERE abs(value - m) / sd > 3)"""
_QUART = """s AS (SELECT list(value ORDER BY value) AS l, count(*) AS n FROM e),
        qq AS (SELECT l[CAST(floor(n * 0.25) AS BIGINT) + 1] AS q1, l[CAST(floor(n * 0.75) AS BIGINT) + 1] AS q3 FROM s)"""
_IQR = f"""{_QUART}, i AS (SELECT idx, value, greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1)) / (q3 - q1) AS score
        FROM e, qq WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"""
_MAD = """md AS (SELECT median(value) AS med FROM e), ma AS (SELECT 1.4826::DOUBLE * median(abs(value - med)) AS mad FROM e, md),
        a AS (SELECT idx, value, abs(value - med) / mad AS score FROM e, md, ma WHERE abs(value - med) / mad > 3.5)"""
_WIN = """wm AS (SELECT idx, value, count(value) OVER w AS k, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM e
        WINDOW w AS (ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW)),
        w AS (SELECT idx, value, abs(value - m) / sd AS score FROM wm WHERE k >= 3 AND sd > 0 AND abs(value - m) / sd > 3)"""
_OUT = "idx, value, round(score, 4) AS score"


def _events(spark, sf, keys=()):
    return anomaly.indexed(table(spark, sf, "events"), "value", ["ts", "event_id"], keys)


def _scored(found, *more):
    return found.select(*more, "idx", "value", F.round("score", 4).alias("score"))


@query("zscore_outliers", "N1", f"{_E}, {_Z} SELECT {_OUT} FROM z")
def zscore_outliers(spark, sf):
    return _scored(anomaly.zscore_anomalies(_events(spark, sf)))


@query(
    "zscore_outliers_per_type",
    "N1",
    f"""{_E} SELECT event_type, {_OUT} FROM (SELECT k.event_type, idx, value, abs(value - m) / sd AS score FROM k JOIN
        (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM k GROUP BY event_type) g ON k.event_type = g.event_type)
        WHERE score > 3""",
)
def zscore_outliers_per_type(spark, sf):
    keys = ["event_type"]
    return _scored(anomaly.zscore_anomalies(_events(spark, sf, keys), keys), *keys)


@query("iqr_outliers", "N2", f"{_E}, {_IQR} SELECT {_OUT} FROM i")
def iqr_outliers(spark, sf):
    return _scored(anomaly.iqr_anomalies(_events(spark, sf)))


@query(
    "iqr_outliers_per_type",
    "N2",
    f"""{_E}, s AS (SELECT event_type, list(value ORDER BY value) AS l, count(*) AS n FROM k GROUP BY event_type),
        qq AS (SELECT event_type, l[CAST(floor(n * 0.25) AS BIGINT) + 1] AS q1, l[CAST(floor(n * 0.75) AS BIGINT) + 1] AS q3 FROM s)
        SELECT event_type, idx, value, round(greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1)) / (q3 - q1), 4) AS score
        FROM k JOIN qq USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def iqr_outliers_per_type(spark, sf):
    keys = ["event_type"]
    return _scored(anomaly.iqr_anomalies(_events(spark, sf, keys), keys), *keys)


@query("mad_outliers", "N3", f"{_E}, {_MAD} SELECT {_OUT} FROM a")
def mad_outliers(spark, sf):
    return _scored(anomaly.mad_anomalies(_events(spark, sf)))


@query(
    "mad_outliers_per_type",
    "N3",
    f"""{_E}, md AS (SELECT event_type, median(value) AS med FROM k GROUP BY event_type),
        ma AS (SELECT event_type, 1.4826::DOUBLE * median(abs(value - med)) AS mad FROM k JOIN md USING (event_type) GROUP BY event_type)
        SELECT event_type, idx, value, round(abs(value - med) / mad, 4) AS score
        FROM k JOIN md USING (event_type) JOIN ma USING (event_type) WHERE abs(value - med) / mad > 3.5""",
)
def mad_outliers_per_type(spark, sf):
    keys = ["event_type"]
    return _scored(anomaly.mad_anomalies(_events(spark, sf, keys), keys), *keys)


@query("window_outliers", "N4", f"{_E}, {_WIN} SELECT {_OUT} FROM w")
def window_outliers(spark, sf):
    return _scored(anomaly.window_anomalies(_events(spark, sf)))


_KM = """WITH RECURSIVE e AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events WHERE value IS NOT NULL),
    st AS (SELECT list(value ORDER BY value) AS l, count(*) AS n FROM e),
    it AS (SELECT 0 AS i, false AS done, l[CAST(floor(n * (0.5::DOUBLE / 3)) AS BIGINT) + 1] AS c0, l[CAST(floor(n * (1.5::DOUBLE / 3)) AS BIGINT) + 1] AS c1,
        l[CAST(floor(n * (2.5::DOUBLE / 3)) AS BIGINT) + 1] AS c2, 0::BIGINT AS n0, 0::BIGINT AS n1, 0::BIGINT AS n2 FROM st
      UNION ALL
      SELECT i + 1, abs(m0 - c0) < 1e-4 AND abs(m1 - c1) < 1e-4 AND abs(m2 - c2) < 1e-4, m0, m1, m2, k0, k1, k2 FROM (
        SELECT i, c0, c1, c2, coalesce(avg(value) FILTER (WHERE a = 0), c0) AS m0, coalesce(avg(value) FILTER (WHERE a = 1), c1) AS m1, coalesce(avg(value) FILTER (WHERE a = 2), c2) AS m2,
          count(*) FILTER (WHERE a = 0) AS k0, count(*) FILTER (WHERE a = 1) AS k1, count(*) FILTER (WHERE a = 2) AS k2
        FROM (SELECT it.*, value, CASE WHEN abs(value - c0) <= abs(value - c1) AND abs(value - c0) <= abs(value - c2) THEN 0 WHEN abs(value - c1) <= abs(value - c2) THEN 1 ELSE 2 END AS a
              FROM it, e WHERE NOT done AND i < 100)
        GROUP BY i, c0, c1, c2)),
    fin AS (SELECT * FROM it ORDER BY i DESC LIMIT 1)"""
_KM_OUT = f"""{_KM}, ds AS (SELECT idx, value, least(abs(value - c0), abs(value - c1), abs(value - c2)) AS dist FROM e, fin),
    rk AS (SELECT *, row_number() OVER (ORDER BY dist DESC, idx) AS r, count(*) OVER () AS n FROM ds), cut AS (SELECT dist AS d FROM rk WHERE r = CAST(ceil(n * 0.1::DOUBLE) AS BIGINT))
    SELECT idx, value, round(dist / d, 4) AS score FROM rk, cut WHERE r <= CAST(ceil(n * 0.1::DOUBLE) AS BIGINT)"""


@query("kmeans_outliers", "N5", _KM_OUT)
def kmeans_outliers(spark, sf):
    return _scored(anomaly.kmeans_anomalies(_events(spark, sf)))


@query(
    "kmeans_clusters",
    "N5",
    f"""{_KM} SELECT 0::INT AS cluster, round(c0, 6) AS centre, n0 AS n FROM fin UNION ALL SELECT 1, round(c1, 6), n1 FROM fin UNION ALL SELECT 2, round(c2, 6), n2 FROM fin""",
)
def kmeans_clusters(spark, sf):
    return anomaly.kmeans_clusters(_events(spark, sf)).withColumn("centre", F.round("centre", 6))


_ENSEMBLE = f"""{_E}, {_Z}, {_IQR}, {_MAD}, u AS (SELECT *, 'zscore' AS method FROM z UNION ALL SELECT *, 'iqr' FROM i UNION ALL SELECT *, 'mad' FROM a),
    en AS (SELECT idx, value, least(max(score) / 3, 1) AS score, string_agg(method, ',' ORDER BY method) AS methods, count(*) AS n_methods
           FROM u GROUP BY idx, value)"""


@query("anomaly_ensemble", "N6", f"{_ENSEMBLE} SELECT idx, value, round(score, 4) AS score, methods FROM en")
def anomaly_ensemble(spark, sf):
    found = anomaly.detect_anomalies(_events(spark, sf))
    return found.select("idx", "value", F.round("score", 4).alias("score"), F.array_join("methods", ",").alias("methods"))


@query(
    "anomaly_bounds",
    "N7",
    f"""{_E}, {_QUART}, md AS (SELECT median(value) AS med FROM e), ma AS (SELECT 1.4826::DOUBLE * median(abs(value - med)) AS mad FROM e, md), {_WIN}
        SELECT method, round(lower, 4) AS lower, round(upper, 4) AS upper FROM (
        SELECT 'zscore' AS method, avg(value) - 3 * stddev_samp(value) AS lower, avg(value) + 3 * stddev_samp(value) AS upper FROM e
        UNION ALL SELECT 'iqr', q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1) FROM qq
        UNION ALL SELECT 'mad', med - 3.5 * mad, med + 3.5 * mad FROM md, ma
        UNION ALL SELECT 'window', min(m - 3 * sd), max(m + 3 * sd) FROM wm WHERE k >= 3 AND sd > 0)""",
)
def anomaly_bounds(spark, sf):
    bounds = anomaly.method_bounds(_events(spark, sf), methods=("zscore", "iqr", "mad", "window"))
    return bounds.select("method", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query(
    "anomaly_summary",
    "N8",
    f"""{_ENSEMBLE}, j AS (SELECT e.idx, e.value, n_methods FROM e LEFT JOIN en ON e.idx = en.idx)
        SELECT count(*) AS total, count(n_methods) AS anomalies, min(value) FILTER (WHERE n_methods IS NOT NULL) AS anomaly_min,
               max(value) FILTER (WHERE n_methods IS NOT NULL) AS anomaly_max, min(value) FILTER (WHERE n_methods IS NULL) AS normal_min,
               max(value) FILTER (WHERE n_methods IS NULL) AS normal_max, count(*) FILTER (WHERE n_methods > 1) AS multi_method,
               round(100 * count(n_methods) / count(*), 4) AS rate_pct,
               CASE WHEN 100 * count(n_methods) / count(*) <= 5 THEN 'low' WHEN 100 * count(n_methods) / count(*) <= 10 THEN 'moderate' ELSE 'high' END AS band
        FROM j""",
)
def anomaly_summary(spark, sf):
    rows = _events(spark, sf)
    return anomaly.anomaly_summary(rows, anomaly.detect_anomalies(rows)).withColumn("rate_pct", F.round("rate_pct", 4))




@query(
    "multi_column_zscores",
    "N9",
    " UNION ALL ".join(
        f"""SELECT event_id, '{c}' AS "column", CAST({c} AS DOUBLE) AS value, round(z, 4) AS z, CASE WHEN z > 3 THEN 'high' ELSE 'medium' END AS severity
            FROM (SELECT event_id, {c}, abs({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z FROM events) WHERE z > 2"""
        for c in ("value", "user_id")
    ),
)
def multi_column_zscores(spark, sf):
    found = anomaly.column_zscores(table(spark, sf, "events"), ["value", "user_id"], ["event_id"], limit=2.0)
    return found.select("event_id", "column", "value", F.round("z", 4).alias("z"), "severity")


@query(
    "multi_column_zscores_listed",
    "N9",
    """SELECT event_id, 'value' AS "column", value, round(z, 4) AS z, CASE WHEN z > 4.5 THEN 'high' ELSE 'medium' END AS severity
       FROM (SELECT event_id, value, abs(value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events) t
       WHERE t.z > 3 ORDER BY t.z DESC, event_id LIMIT 100""",
)
def multi_column_zscores_listed(spark, sf):
    found = anomaly.column_zscores(table(spark, sf, "events"), None, ["event_id"])
    return anomaly.listed_anomalies(found, ["event_id"]).withColumn("z", F.round("z", 4)).select("event_id", "column", "value", "z", "severity")


@query(
    "table_anomalies",
    "N10",
    """WITH e AS (SELECT p_retailprice AS value, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part),
            r AS (SELECT idx, value, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM e)
       SELECT idx, value, round(least(abs(z) / 1.5, 1), 4) AS score FROM r WHERE abs(z) > 1.5""",
)
def table_anomalies(spark, sf):
    found = anomaly.anomalies_of_table(table(spark, sf, "part"), ["p_partkey"], "p_retailprice", methods=("zscore",), threshold=1.5)
    return _scored(found)
