"""Files written from the tables and read back, type inference, reports, automatic analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import auto, insights
from tablelens.plans.registry import query, table
from tablelens.session import scratch_path
from tablelens.sources import files

_ORDERS = """SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, o_totalprice,
             CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"""


def _written(spark, df, name):
    path = scratch_path(spark, name) + ".csv"
    files.write_csv(df, path)
    return path


@query("csv_round_trip", "S1 S2 S4 S6 S10", _ORDERS)
def csv_round_trip(spark, sf):
    return files.load(spark, _written(spark, table(spark, sf, "orders"), "orders"))


@query("csv_text_quoting", "S1 S10", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, regexp_replace('\"' || text || '\" x', '^\\s+|\\s+$', '', 'g') AS quoted FROM conversations")
def csv_text_quoting(spark, sf):
    turns = table(spark, sf, "conversations")
    quoted = F.concat(F.lit('"'), "text", F.lit('" x'))
    return files.read_csv_text(spark, _written(spark, turns.select("conv_id", "turn", "role", quoted.alias("quoted")), "turns"))


@query("csv_import_profile", "S6 S9 I1")
def csv_import_profile(spark, sf):
    df = files.load(spark, _written(spark, table(spark, sf, "supplier"), "supplier"))
    path = scratch_path(spark, "supplier-table")
    files.write_parquet(df, path)
    from tablelens.operators.profile import column_profile

    return column_profile(spark.read.parquet(path))


@query("parquet_load", "S7", "SELECT * FROM customer")
def parquet_load(spark, sf):
    return files.load(spark, f"{sf}/customer.parquet")


def _text_events(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "yyyy/MM/dd").alias("slash_day"),
        F.when(F.col("event_type") == "click", "yes").when(F.col("event_type") == "view", "0").otherwise("").alias("flag"),
        F.col("value").cast("string").alias("value"),
        F.when(F.col("event_type") == "error", F.col("value").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("mixed"),
        F.lit(" ").alias("blank"),
        "props",
    )


_TEXT_EVENTS = """te AS (SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y/%m/%d') AS slash_day,
    CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN '0' ELSE '' END AS flag, CAST(value AS VARCHAR) AS value,
    CASE WHEN event_type = 'error' THEN CAST(value AS VARCHAR) ELSE strftime(ts, '%Y-%m-%d') END AS mixed, ' ' AS blank, props FROM events)"""
_NAMES = ("id", "day", "slash_day", "flag", "value", "mixed", "blank", "props")


def _infer_sql(spreadsheet: bool) -> str:
    number = "regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"
    date = "coalesce(try_strptime(v, '%Y-%m-%d') IS NOT NULL OR try_strptime(v, '%Y/%m/%d') IS NOT NULL, false)"
    if spreadsheet:
        date = f"({date} OR ({number} AND try_cast(v AS DOUBLE) BETWEEN 1 AND 2958465.9999))"
    parts = [
        f"""SELECT '{c}' AS "column", {i} AS position, CASE WHEN count(v) = 0 THEN 'string' WHEN bool_and(lower(v) IN ('true','false','yes','no','1','0')) THEN 'boolean'
            WHEN bool_and({number}) THEN 'number' WHEN bool_and({date}) THEN 'date' ELSE 'string' END AS class FROM (SELECT nullif(trim({c}), '') AS v FROM te) WHERE v IS NOT NULL"""
        for i, c in enumerate(_NAMES)
    ]
    return f"WITH {_TEXT_EVENTS} {' UNION ALL '.join(parts)}"


@query("type_inference", "S2", _infer_sql(False))
def type_inference(spark, sf):
    return files.infer_types(_text_events(spark, sf))


@query("type_inference_spreadsheet", "S3", _infer_sql(True))
def type_inference_spreadsheet(spark, sf):
    return files.infer_types(_text_events(spark, sf), spreadsheet=True)


@query(
    "typed_coercion",
    "S4",
    f"""WITH {_TEXT_EVENTS} SELECT CAST(id AS DOUBLE) AS id, CAST(try_strptime(slash_day, '%Y/%m/%d') AS DATE) AS slash_day,
        CASE WHEN flag = '' THEN NULL ELSE flag IN ('true', 'yes', '1') END AS flag, try_cast(value AS DOUBLE) AS value,
        CAST(try_strptime(mixed, '%Y-%m-%d') AS DATE) AS mixed, NULL::VARCHAR AS blank FROM te""",
)
def typed_coercion(spark, sf):
    kinds = {"id": "number", "slash_day": "date", "flag": "boolean", "value": "number", "mixed": "date", "blank": "string"}
    return files.apply_types(_text_events(spark, sf), kinds)


@query("serial_dates", "S5", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def serial_dates(spark, sf):
    orders = table(spark, sf, "orders")
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")) + 0.75
    return orders.select("o_orderkey", files.serial_date(serial).alias("day"))


@query("table_replace", "S9", "SELECT * FROM nation")
def table_replace(spark, sf):
    path = scratch_path(spark, "nation")
    files.write_parquet(table(spark, sf, "region"), path)
    files.write_parquet(table(spark, sf, "nation"), path)
    return spark.read.parquet(path)


@query(
    "json_report",
    "S11",
    """SELECT 'orders' AS "table", count(*) AS row_count, 6::BIGINT AS statistics FROM orders UNION ALL SELECT 'customer', count(*), 5 FROM customer""",
)
def json_report(spark, sf):
    tables = {"orders": table(spark, sf, "orders"), "customer": table(spark, sf, "customer")}
    found = {"orders": insights.analyze_table(tables["orders"], "o_orderkey"), "customer": insights.analyze_table(tables["customer"], "c_custkey")}
    path = scratch_path(spark, "report")
    files.write_report(files.report_rows("analysis", tables, found), path)
    back = spark.read.json(path)
    return back.select("table", F.col("overview.row_count").alias("row_count"), F.size("statistics").cast("long").alias("statistics"))


@query("auto_analysis", "I15")
def auto_analysis(spark, sf):
    return auto.auto_analysis(table(spark, sf, "orders"), ["o_orderkey"])


