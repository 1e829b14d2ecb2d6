"""Automatic analysis of a table: the analyses its column classes allow, as one long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablelens.operators import anomaly, association, correlation, forecast
from tablelens.operators.profile import columns_of

def analyses(df: DataFrame, order_by: Sequence[str], horizon: int = 5) -> dict[str, DataFrame]:
    """The result frames by analysis; an error when no analysis fits."""
    dates, numbers, texts = (columns_of(df, c) for c in ("date", "number", "string"))
    out: dict[str, DataFrame] = {}
    if dates and numbers:
        out["forecast"] = forecast.forecast_table(df, order_by, numbers[0], dates[0], horizon)
    if len(numbers) >= 2:
        out["correlation"] = correlation.correlate_table(df, columns=numbers)
    if numbers:
        out["anomaly"] = anomaly.anomalies_of_table(df, order_by, numbers[0])
    if len(texts) >= 2:
        out["association"] = association.rules_of_table(df, texts)
    if not out:
        raise ValueError("no analysis fits the columns of this table")
    return out


def auto_analysis(df: DataFrame, order_by: Sequence[str], horizon: int = 5) -> DataFrame:
    """``(analysis, subject, metric, value)`` over all analyses."""
    shapes = {
        "forecast": (F.concat_ws(" ", F.lit("step"), F.col("step")), "value"),
        "correlation": (F.concat_ws(" ~ ", "col1", "col2"), "r"),
        "anomaly": (F.concat_ws(" ", F.lit("row"), F.col("idx")), "score"),
        "association": (F.concat_ws(" => ", F.concat_ws(", ", "antecedent"), F.concat_ws(", ", "consequent")), "lift"),
    }
    out = None
    for name, frame in analyses(df, order_by, horizon).items():
        subject, metric = shapes[name]
        rows = frame.select(F.lit(name).alias("analysis"), subject.alias("subject"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
