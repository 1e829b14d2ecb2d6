"""Column projections and read-only ad-hoc SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PREVIEW_ROWS = 1000
_FORBIDDEN = ("drop", "delete", "truncate")
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def to_number(col: Column | str) -> Column:
    """Numeric value of a cell; NULL where it is not a number."""
    return F.expr(f"try_cast(`{col}` AS DOUBLE)") if isinstance(col, str) else col.try_cast("double")


def numeric_column(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    return df.select(*order_by, to_number(column).alias("value")).where(F.col("value").isNotNull())


def date_value_series(df: DataFrame, date_col: str, value_col: str, tie: str) -> DataFrame:
    """Dated values with a stable index; rows lacking either part are dropped."""
    from tablelens.operators.ordering import with_row_index

    rows = df.select(F.col(date_col).alias("ts"), F.col(tie).alias("tie"), to_number(value_col).alias("value"))
    return with_row_index(rows.dropna(subset=["ts", "value"]), ["ts", "tie"])


def numeric_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Several columns as numbers; rows in which all of them are NULL are dropped."""
    return df.select(*keep, *[to_number(c).alias(c) for c in columns]).dropna(how="all", subset=list(columns))


def guard_sql(sql: str) -> str:
    """Refuse what changes data: words of literals, quoted names and comments do not count."""
    text = sql.strip().rstrip(";").strip()
    bare = _QUOTED.sub(" ", text).lower()
    for word in _FORBIDDEN:
        if re.search(rf"\b{word}\s", bare):
            raise ValueError(f"statement contains forbidden operation: {word}")
    if not re.match(r"\s*(select|with)\b", bare):
        raise ValueError("only SELECT or WITH statements are allowed")
    return text


def run_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run a query over the given tables only by their names.

    The statement stands in the place of a subquery, where Spark's parser accepts nothing that writes. The tables
    are views of unique names while it is analysed; the caller's views stay as they are.
    """
    text = guard_sql(sql)
    mark = uuid.uuid4().hex
    views = {name: f"_{i}_{mark}" for i, name in enumerate(tables)}
    for name, df in tables.items():
        df.createOrReplaceTempView(views[name])
    named = ", ".join(f"`{name}` AS (SELECT * FROM `{view}`)" for name, view in views.items())
    try:
        return spark.sql(f"{f'WITH {named} ' if named else ''}SELECT * FROM (\n{text}\n)")
    except ParseException as error:
        raise ValueError("only SELECT or WITH statements are allowed") from error
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def preview(df: DataFrame, order_by: Sequence[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(*order_by).limit(rows)
