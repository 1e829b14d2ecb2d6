"""Automatic findings about a table, as rows ``(seq, insight, subject, significance, metric)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tablelens.operators.ordering import value_prefix_counts, with_row_index
from tablelens.operators.profile import column_profile, columns_of

# fixed values: thresholds of the findings
LARGE_ROWS, SMALL_ROWS = 1_000_000, 100
NULL_RATE, DISPERSION, SIGMAS = 0.3, 1.0, 3.0
KEY_MIN_ROWS, LOW_CARDINALITY_RATE, LOW_CARDINALITY = 10, 0.05, 10
TREND_PCT, STRONG_TREND_PCT = 10.0, 20.0
CORRELATED, STRONGLY_CORRELATED = 0.5, 0.7


def _finding(insight: str, significance, metric) -> F.Column:
    level = F.lit(significance) if isinstance(significance, str) else significance
    return F.struct(F.lit(insight).alias("insight"), level.alias("significance"), metric.cast("double").alias("metric"))


def size_finding(profile: DataFrame) -> DataFrame:
    rows = profile.agg(F.max("rows").alias("rows"))
    found = F.when(F.col("rows") > LARGE_ROWS, _finding("large_table", "medium", F.col("rows"))).when(
        F.col("rows") < SMALL_ROWS, _finding("small_table", "low", F.col("rows"))
    )
    return rows.select(found.alias("f")).where(F.col("f").isNotNull()).select(
        F.lit(0).alias("seq"), F.lit(None).cast("string").alias("subject"), "f.*"
    )


def column_findings(profile: DataFrame) -> DataFrame:
    """Missing cells, dispersion, three-sigma breach, candidate key, low cardinality."""
    rate = F.try_divide(F.col("nulls").cast("double"), F.col("rows").cast("double"))
    numeric = F.col("class") == "number"
    cv = F.coalesce(F.try_divide(F.col("stddev"), F.abs("mean")), F.lit(0.0))
    low, high = F.col("mean") - SIGMAS * F.col("stddev"), F.col("mean") + SIGMAS * F.col("stddev")
    is_key = (F.col("distinct") == F.col("rows")) & (F.col("rows") > KEY_MIN_ROWS)
    ratio = F.try_divide(F.col("distinct").cast("double"), F.col("rows").cast("double"))
    few = (ratio < LOW_CARDINALITY_RATE) & (F.col("class") == "string") & (F.col("distinct") <= LOW_CARDINALITY)
    checks = F.array(
        F.when(rate > NULL_RATE, _finding("missing_values", "high", rate)),
        F.when(numeric & (cv > DISPERSION), _finding("high_dispersion", "medium", cv)),
        F.when(numeric & ((F.col("min") < low) | (F.col("max") > high)), _finding("three_sigma_breach", "medium", F.greatest(low - F.col("min"), F.col("max") - high))),
        F.when(is_key, _finding("candidate_key", "low", F.col("distinct"))),
        F.when(few & ~is_key, _finding("low_cardinality", "low", F.col("distinct"))),
    )
    # the emit order is rule by rule, then column by column
    found = profile.select("column", "position", F.posexplode(checks).alias("rule", "f")).where(F.col("f").isNotNull())
    width = profile.agg(F.count(F.lit(1))).first()[0] + 1
    return found.select(
        (1 + F.col("rule") * width + F.col("position")).cast("int").alias("seq"), F.col("column").alias("subject"), "f.*"
    )


def half_split_means(df: DataFrame, date_col: str, value_col: str, tie: str) -> tuple[float | None, float | None]:
    """Mean of the first and of the second half in date order.

    Only the date that holds the cut is put in order row by row; all other dates fall on one side
    as a whole.
    """
    # the cut travels as text or microseconds, which no time zone changes
    date = F.unix_micros(date_col) if isinstance(df.schema[date_col].dataType, T.TimestampType) else F.col(date_col)
    rows = df.select(date.alias("d"), F.col(value_col).cast("double").alias("v"), F.col(tie).alias("t")).dropna(subset=["d", "v"])
    prefix = value_prefix_counts(rows, "d")
    half = F.floor(F.col("total") / 2)
    at_cut = prefix.where((F.col("before") <= half) & (half < F.col("before") + F.col("cnt")))
    cut = at_cut.select(F.col("d").cast("string").alias("d"), "before", "total").first()
    if cut is None:
        return None, None
    day = F.lit(cut["d"]).cast(rows.schema["d"].dataType)
    first_rank = cut["total"] // 2 - cut["before"]
    sides = rows.where(F.col("d") != day).select((F.col("d") < day).alias("first"), "v")
    split = with_row_index(rows.where(F.col("d") == day), ["t"]).select((F.col("idx") < first_rank).alias("first"), "v")
    means = {r["first"]: r["m"] for r in sides.unionByName(split).groupBy("first").agg(F.avg("v").alias("m")).collect()}
    return means.get(True), means.get(False)


def trend_finding(df: DataFrame, date_col: str, value_col: str, tie: str) -> DataFrame:
    first, second = half_split_means(df, date_col, value_col, tie)
    rows = []
    if first and second:
        change = (second - first) / first * 100
        if abs(change) > TREND_PCT:
            rows.append(("half_split_trend", value_col, "high" if abs(change) > STRONG_TREND_PCT else "medium", change))
    return _driver_rows(df, rows, 1_000_000)


def correlation_finding(df: DataFrame, first: str, second: str) -> DataFrame:
    from tablelens.operators.correlation import pearson

    r = pearson(df, first, second).first()["r"]
    rows = []
    if abs(r) > CORRELATED:
        rows.append(("correlated_columns", f"{first}, {second}", "high" if abs(r) > STRONGLY_CORRELATED else "medium", r))
    return _driver_rows(df, rows, 1_000_001)


def _driver_rows(df: DataFrame, rows: list, seq: int) -> DataFrame:
    schema = "seq int, subject string, insight string, significance string, metric double"
    return df.sparkSession.createDataFrame([(seq, s, i, level, float(m)) for i, s, level, m in rows], schema)


def ordered_by_significance(findings: DataFrame) -> DataFrame:
    """High before medium before low; the emit order breaks ties."""
    level = F.when(F.col("significance") == "high", 0).when(F.col("significance") == "medium", 1).otherwise(2)
    return findings.select("seq", "insight", "subject", "significance", "metric", level.alias("level")).orderBy("level", "seq")


def analyze_table(df: DataFrame, tie: str, approximate: bool = False) -> DataFrame:
    """All findings for one table. ``tie`` is a unique column that orders equal dates."""
    from tablelens.session import materialize

    profile = materialize(column_profile(df, approximate=approximate))
    found = size_finding(profile).unionByName(column_findings(profile))
    dates, numbers = columns_of(df, "date"), columns_of(df, "number")
    if dates and numbers:
        found = found.unionByName(trend_finding(df, dates[0], numbers[0], tie))
    if len(numbers) >= 2:
        found = found.unionByName(correlation_finding(df, numbers[0], numbers[1]))
    return ordered_by_significance(found)
