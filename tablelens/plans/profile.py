"""Profiles and automatic findings on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import insights, profile
from tablelens.plans.registry import query, table

LINEITEM = {
    "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number",
    "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "date",
}
EVENTS = {"event_id": "number", "ts": "date", "user_id": "number", "event_type": "string", "value": "number", "props": "string"}
CUSTOMER = {"c_custkey": "number", "c_name": "string", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "string"}
ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def profile_sql(name: str, columns: dict[str, str], places: int | None = 4) -> str:
    rows = []
    r = (lambda e: f"round({e}, {places})") if places is not None else (lambda e: e)
    for pos, (c, cls) in enumerate(columns.items()):
        if cls == "number":
            x = f"CAST({c} AS DOUBLE)"
            nums = f"min({x}) AS min, max({x}) AS max, {r(f'avg({x})')} AS mean, {r(f'stddev_samp({x})')} AS stddev, {r(f'median({x})')} AS median"
        else:
            nums = ", ".join(f"CAST(NULL AS DOUBLE) AS {m}" for m in ("min", "max", "mean", "stddev", "median"))
        rows.append(
            f"""SELECT '{c}' AS "column", {pos} AS position, '{cls}' AS class, count(*) AS "rows", count(*) - count({c}) AS nulls,
                count(DISTINCT {c}) AS "distinct", {nums} FROM {name}"""
        )
    return " UNION ALL ".join(rows)


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "stddev", "median")})


@query("lineitem_profile", "I4 S7", profile_sql("lineitem", LINEITEM))
def lineitem_profile(spark, sf):
    return _rounded(profile.column_profile(table(spark, sf, "lineitem")))


@query("events_profile", "I4", profile_sql("events", EVENTS))
def events_profile(spark, sf):
    return _rounded(profile.column_profile(table(spark, sf, "events")))


@query("customer_profile", "I4", profile_sql("customer", CUSTOMER))
def customer_profile(spark, sf):
    return _rounded(profile.column_profile(table(spark, sf, "customer")))


@query("lineitem_profile_approximate", "I4")
def lineitem_profile_approximate(spark, sf):
    return profile.column_profile(table(spark, sf, "lineitem"), approximate=True)


@query(
    "lineitem_overview",
    "I3",
    """SELECT count(*) AS row_count, 11::BIGINT AS column_count,
              'l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax' AS numeric_columns,
              'l_returnflag, l_linestatus' AS string_columns, 'l_shipdate' AS date_columns,
              CAST(min(l_shipdate) AS DATE) AS first_date, CAST(max(l_shipdate) AS DATE) AS last_date FROM lineitem""",
)
def lineitem_overview(spark, sf):
    return profile.overview(table(spark, sf, "lineitem"))


_SHAPES = {
    "region": (2, 1, 0), "nation": (3, 2, 0), "customer": (5, 3, 0), "supplier": (4, 3, 0), "part": (6, 3, 0), "orders": (6, 3, 1),
    "lineitem": (11, 8, 1), "events": (6, 3, 1), "documents": (5, 2, 0), "embeddings": (3, 2, 0), "pages": (3, 1, 0),
    "benchmark": (2, 1, 0), "labels": (3, 3, 0), "conversations": (4, 2, 0),
}


@query(
    "all_tables_profile",
    "I2",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS row_count, {c}::BIGINT AS column_count, {n}::BIGINT AS numeric_count, {d}::BIGINT AS date_count FROM {t}"""
        for t, (c, n, d) in _SHAPES.items()
    ),
)
def all_tables_profile(spark, sf):
    return profile.all_tables({t: table(spark, sf, t) for t in ALL_TABLES})


_SAMPLES = """cl AS (SELECT * FROM (VALUES ('o_orderkey', 'number'), ('o_custkey', 'number'), ('o_orderstatus', 'string'), ('o_totalprice', 'number'), ('o_orderdate', 'date'), ('o_orderpriority', 'string')) t("column", class)),
    ce AS (SELECT * FROM (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders)
      UNPIVOT (value FOR "column" IN (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority))),
    sa AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS r FROM (SELECT DISTINCT "column", value FROM ce))"""


@query("column_samples", "I1", f"""WITH {_SAMPLES} SELECT "column", class, list(value ORDER BY value) AS samples FROM sa JOIN cl USING ("column") WHERE r <= 5 GROUP BY ALL""")
def column_samples(spark, sf):
    return profile.column_samples(table(spark, sf, "orders"))


@query(
    "schema_description",
    "I1",
    f"""WITH {_SAMPLES}, li AS (SELECT "column", "column" || ' (' || class || '): ' || string_agg(value, ', ' ORDER BY value) AS line FROM sa JOIN cl USING ("column") WHERE r <= 3 GROUP BY "column", class)
        SELECT 'orders' AS "table", string_agg(line, chr(10) ORDER BY "column") AS description FROM li""",
)
def schema_description(spark, sf):
    return profile.describe_schema(table(spark, sf, "orders"), "orders")


def findings_sql(name: str, columns: dict[str, str]) -> str:
    """Column findings from the profile, by the same numeric thresholds, written as plain filters."""
    p = f"WITH p AS ({profile_sql(name, columns, None)})"
    q = "SELECT '{i}' AS insight, \"column\" AS subject, '{s}' AS significance, CAST({m} AS DOUBLE) AS metric FROM p WHERE {w}"
    parts = [
        "SELECT CASE WHEN max(\"rows\") > 1000000 THEN 'large_table' ELSE 'small_table' END AS insight, NULL AS subject, "
        "CASE WHEN max(\"rows\") > 1000000 THEN 'medium' ELSE 'low' END AS significance, CAST(max(\"rows\") AS DOUBLE) AS metric "
        "FROM p HAVING max(\"rows\") > 1000000 OR max(\"rows\") < 100",
        q.format(i="missing_values", s="high", m='nulls / "rows"', w='nulls / "rows" > 0.3'),
        q.format(i="high_dispersion", s="medium", m="stddev / abs(mean)", w="mean <> 0 AND stddev / abs(mean) > 1"),
        q.format(
            i="three_sigma_breach", s="medium", m="greatest(mean - 3 * stddev - min, max - mean - 3 * stddev)",
            w="min < mean - 3 * stddev OR max > mean + 3 * stddev",
        ),
        q.format(i="candidate_key", s="low", m='"distinct"', w='"distinct" = "rows" AND "rows" > 10'),
        q.format(
            i="low_cardinality", s="low", m='"distinct"',
            w="""class = 'string' AND "distinct" <= 10 AND "distinct" / "rows" < 0.05 AND NOT ("distinct" = "rows" AND "rows" > 10)""",
        ),
    ]
    return f"{p} {' UNION ALL '.join(parts)}"


def _table_findings_sql(name, columns, date, number, second, tie) -> str:
    halves = f"""(SELECT avg(v) FILTER (WHERE rn <= floor(total / 2)) AS a, avg(v) FILTER (WHERE rn > floor(total / 2)) AS b FROM
        (SELECT {number} AS v, row_number() OVER (ORDER BY {date}, {tie}) AS rn, count(*) OVER () AS total FROM {name}
         WHERE {date} IS NOT NULL AND {number} IS NOT NULL))"""
    return f"""SELECT insight, subject, significance, round(metric, 4) AS metric FROM ({findings_sql(name, columns)}
        UNION ALL SELECT 'half_split_trend', '{number}', CASE WHEN abs((b - a) / a * 100) > 20 THEN 'high' ELSE 'medium' END, (b - a) / a * 100
          FROM {halves} WHERE a <> 0 AND b <> 0 AND abs((b - a) / a * 100) > 10
        UNION ALL SELECT 'correlated_columns', '{number}, {second}', CASE WHEN abs(r) > 0.7 THEN 'high' ELSE 'medium' END, r
          FROM (SELECT corr({number}, {second}) AS r FROM {name}) WHERE abs(r) > 0.5)"""


def _findings(df):
    return df.select("insight", "subject", "significance", F.round("metric", 4).alias("metric"))


@query("events_findings", "I5 I6 I7 I8 I9 I10 I11 I12 I13 I14", _table_findings_sql("events", EVENTS, "ts", "event_id", "user_id", "event_id"))
def events_findings(spark, sf):
    return _findings(insights.analyze_table(table(spark, sf, "events"), "event_id"))


@query("orders_findings", "I14", _table_findings_sql(
    "orders",
    {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number", "o_orderdate": "date", "o_orderpriority": "string"},
    "o_orderdate", "o_orderkey", "o_custkey", "o_orderkey",
))
def orders_findings(spark, sf):
    return _findings(insights.analyze_table(table(spark, sf, "orders"), "o_orderkey"))


@query("customer_findings", "I5 I9 I10 I13", f"SELECT insight, subject, significance, round(metric, 4) AS metric FROM ({findings_sql('customer', CUSTOMER)})")
def customer_findings(spark, sf):
    prof = profile.column_profile(table(spark, sf, "customer"))
    found = insights.size_finding(prof).unionByName(insights.column_findings(prof))
    return _findings(insights.ordered_by_significance(found))


@query("nation_findings", "I5 I9", f"SELECT insight, subject, significance, round(metric, 4) AS metric FROM ({findings_sql('nation', {'n_nationkey': 'number', 'n_name': 'string', 'n_regionkey': 'number'})})")
def nation_findings(spark, sf):
    prof = profile.column_profile(table(spark, sf, "nation"))
    found = insights.size_finding(prof).unionByName(insights.column_findings(prof))
    return _findings(insights.ordered_by_significance(found))


@query(
    "missing_value_findings",
    "I6",
    f"""WITH sparse AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS purchase_value, user_id FROM events)
        SELECT insight, subject, significance, round(metric, 4) AS metric FROM (
          {findings_sql('sparse', {'event_id': 'number', 'purchase_value': 'number', 'user_id': 'number'}).replace('WITH p AS', 'WITH p AS', 1)}) WHERE insight = 'missing_values'""",
)
def missing_value_findings(spark, sf):
    sparse = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase_value"), "user_id")
    found = _findings(insights.column_findings(profile.column_profile(sparse)))
    return found.where(F.col("insight") == "missing_values")


@query(
    "half_split_trend",
    "I11",
    """SELECT round(avg(v) FILTER (WHERE rn <= floor(total / 2)), 4) AS first_mean, round(avg(v) FILTER (WHERE rn > floor(total / 2)), 4) AS second_mean
       FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS total FROM orders)""",
)
def half_split_trend(spark, sf):
    first, second = insights.half_split_means(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderkey")
    return spark.createDataFrame([(round(first, 4), round(second, 4))], "first_mean double, second_mean double")
