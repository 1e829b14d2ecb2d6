"""Table profile: logical classes, overview, per-column statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablelens.operators.ordering import MEDIAN_HIGH, MEDIAN_LOW, order_stats, value_prefix_counts



def logical_class(kind: T.DataType) -> str:
    """``number``, ``date``, ``boolean``, ``string`` or ``other``."""
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "other"


def classify(df: DataFrame) -> dict[str, str]:
    return {f.name: logical_class(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, wanted: str) -> list[str]:
    return [name for name, cls in classify(df).items() if cls == wanted]


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, column lists by class, range of the first date column."""
    classes = classify(df)
    named = {c: [n for n, k in classes.items() if k == c] for c in ("number", "string", "date")}
    aggs = [F.count(F.lit(1)).alias("row_count")]
    dates = named["date"]
    first = F.min(dates[0]) if dates else F.lit(None)
    last = F.max(dates[0]) if dates else F.lit(None)
    out = df.agg(*aggs, first.cast("date").alias("first_date"), last.cast("date").alias("last_date"))
    return out.select(
        "row_count",
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.lit(", ".join(named["number"])).alias("numeric_columns"),
        F.lit(", ".join(named["string"])).alias("string_columns"),
        F.lit(", ".join(named["date"])).alias("date_columns"),
        "first_date",
        "last_date",
    )


def _as_rows(wide: DataFrame, columns: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """One row per column from a single-row aggregate whose names are ``<position>_<field>``."""
    items = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(pos).alias("position"),
            *[F.col(f"`{pos}_{field}`").cast(kind).alias(field) for field, kind in fields.items()],
        )
        for pos, name in enumerate(columns)
    ]
    return wide.select("rows", F.inline(F.array(*items)))


def _moments(df: DataFrame, columns: Sequence[str], classes: Mapping[str, str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for pos, name in enumerate(columns):
        col = F.col(f"`{name}`")
        number = col.cast("double") if classes[name] == "number" else F.lit(None).cast("double")
        aggs += [
            F.count_if(col.isNull()).alias(f"{pos}_nulls"),
            F.min(number).alias(f"{pos}_min"),
            F.max(number).alias(f"{pos}_max"),
            F.avg(number).alias(f"{pos}_mean"),
            F.stddev_samp(number).alias(f"{pos}_stddev"),
        ]
    fields = {"nulls": "long", "min": "double", "max": "double", "mean": "double", "stddev": "double"}
    return _as_rows(df.agg(*aggs), columns, fields)


def _number_ranks(df: DataFrame, columns: Sequence[str], positions: Mapping[str, int]) -> DataFrame:
    """Exact distinct count and median of all numeric columns from one sort of distinct values."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str):
        col = F.col(f"`{name}`")
        whole = col.cast("long") if isinstance(kinds[name], T.IntegralType) else F.lit(None).cast("long")
        text = col.cast("string") if isinstance(kinds[name], T.DecimalType) else F.lit(None).cast("string")
        value = F.when(col.isNotNull(), F.struct(col.cast("double").alias("d"), whole.alias("l"), text.alias("s")))
        return F.struct(F.lit(positions[name]).alias("position"), value.alias("v"))

    long = df.select(F.inline(F.array(*[cell(c) for c in columns])))
    prefix = value_prefix_counts(long, "v", ["position"])
    ranks = order_stats(prefix, "v", {"lo": MEDIAN_LOW, "hi": MEDIAN_HIGH}, ["position"], distinct_name="distinct")
    return ranks.select("position", "distinct", ((F.col("lo.d") + F.col("hi.d")) / 2).alias("median"))


def _text_distinct(df: DataFrame, columns: Sequence[str], positions: Mapping[str, int]) -> DataFrame:
    cells = [F.struct(F.lit(positions[c]).alias("position"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]
    pairs = df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull()).groupBy("position", "v").agg(F.lit(1).alias("one"))
    return pairs.groupBy("position").agg(F.count(F.lit(1)).alias("distinct"), F.lit(None).cast("double").alias("median"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Row, null and distinct counts per column; min, max, mean, sample sd and median for numbers.

    Exact distinct counts and medians group each column's values before sorting them. With
    ``approximate`` both come from sketches in the same scan as the other figures.
    """
    classes = classify(df)
    columns = [c for c in (columns or df.columns) if classes[c] != "other"]
    positions = {c: i for i, c in enumerate(columns)}
    labels = F.create_map(*[F.lit(x) for c in columns for x in (c, classes[c])])
    base = _moments(df, columns, classes)
    numbers = [c for c in columns if classes[c] == "number"]
    others = [c for c in columns if classes[c] != "number"]
    if approximate:
        aggs = [F.count(F.lit(1)).alias("rows")]
        for c, pos in positions.items():
            middle = F.percentile_approx(F.col(f"`{c}`").cast("double"), 0.5, 10000) if c in numbers else F.lit(None)
            aggs += [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"{pos}_distinct"), middle.alias(f"{pos}_median")]
        counted = _as_rows(df.agg(*aggs), columns, {"distinct": "long", "median": "double"}).select("position", "distinct", "median")
    else:
        branches = []
        if numbers:
            branches.append(_number_ranks(df, numbers, positions))
        if others:
            branches.append(_text_distinct(df, others, positions))
        counted = branches[0]
        for more in branches[1:]:
            counted = counted.unionByName(more)
    # both sides have one row per column
    return base.join(F.broadcast(counted), "position", "left").select(
        "column",
        "position",
        labels[F.col("column")].alias("class"),
        "rows",
        "nulls",
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        "min",
        "max",
        "mean",
        "stddev",
        "median",
    )


def column_samples(df: DataFrame, per_column: int = 5) -> DataFrame:
    """Class and the ``per_column`` smallest distinct values (as text) per column, over all rows."""
    classes = classify(df)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    values = df.select(F.inline(cells)).where("value is not null").distinct()
    w = Window.partitionBy("column").orderBy("value")
    few = values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_column)
    lists = few.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    names = df.sparkSession.createDataFrame(list(classes.items()), "column string, class string")
    return names.join(lists, "column", "left").select("column", "class", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def describe_schema(df: DataFrame, table: str, samples: int = 3) -> DataFrame:
    """One text line per table: column names, classes and a few values."""
    parts = column_samples(df, samples).select(
        F.format_string("%s (%s): %s", "column", "class", F.array_join("samples", ", ")).alias("line"), "column"
    )
    ordered = F.array_sort(F.collect_list(F.struct("column", "line")))
    return parts.agg(F.lit(table).alias("table"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("description"))


def all_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row and column counts and class counts of every table."""
    out = None
    for name, df in tables.items():
        classes = list(classify(df).values())
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table"),
            "row_count",
            F.lit(len(classes)).cast("long").alias("column_count"),
            F.lit(classes.count("number")).cast("long").alias("numeric_count"),
            F.lit(classes.count("date")).cast("long").alias("date_count"),
        )
        out = row if out is None else out.unionByName(row)
    return out
