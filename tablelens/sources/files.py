"""CSV and parquet ingest with type inference, and the table, CSV and report sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablelens.functions.text import strip_space
from tablelens.operators.profile import column_profile, overview

# fixed values: accepted spellings
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0")
TRUE_WORDS = ("true", "yes", "1")
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE_TEXT = r"^\d{4}[-/]\d{2}[-/]\d{2}([ T].*)?$"
SERIAL_LOW, SERIAL_HIGH = 1.0, 2958465.9999
SERIAL_EPOCH = "1899-12-30"


# ---- names ---------------------------------------------------------------------------------

def clean_name(name: str, ascii_only: bool = False) -> str:
    """Letters, digits, underscore and CJK kept, others replaced; ``ascii_only`` lower-cases as well."""
    cleaned = re.sub(r"[^a-z0-9_]", "_", name.lower()) if ascii_only else re.sub(r"[^一-龥a-zA-Z0-9_]", "_", name)
    if not cleaned:
        raise ValueError("empty name")
    return cleaned


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated names get ``_1``, ``_2``, ... (case does not tell columns apart in Spark)."""
    used: set[str] = set()
    out = []
    for name in names:
        fresh, k = name, 1
        while fresh.lower() in used:
            fresh, k = f"{name}_{k}", k + 1
        used.add(fresh.lower())
        out.append(fresh)
    return out


# ---- cells ---------------------------------------------------------------------------------

def is_number(v: Column) -> Column:
    return v.rlike(NUMBER_TEXT)


def as_date(v: Column) -> Column:
    day = F.replace(F.substring(v, 1, 10), F.lit("/"), F.lit("-"))
    return F.when(v.rlike(DATE_TEXT), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"))


def coerce(v: Column, kind: str) -> Column:
    """Typed value of a text cell; blank and unreadable cells become NULL."""
    cell = F.when(v != "", v)
    if kind == "number":
        return F.when(is_number(cell), cell.try_cast("double"))
    if kind == "boolean":
        return F.when(cell.isNotNull(), F.lower(cell).isin(*TRUE_WORDS))
    if kind == "date":
        return as_date(cell)
    return cell


def serial_date(v: Column) -> Column:
    """Spreadsheet serial day number to date."""
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(v).cast("int"))


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, sample_rows: int | None = None, spreadsheet: bool = False, zero_one_boolean: bool = True) -> DataFrame:
    """``(column, position, class)`` of text columns: boolean, number, date, else string.

    One aggregate over all rows, or over the first ``sample_rows``. In a spreadsheet a number in the
    range of serial days also counts as a date.
    """
    columns = list(columns or df.columns)
    rows = df.select(*columns)
    if sample_rows is not None:
        rows = rows.limit(sample_rows)
    words = BOOLEAN_WORDS if zero_one_boolean else BOOLEAN_WORDS[:4]
    aggs = []
    for i, c in enumerate(columns):
        v = strip_space(F.col(f"`{c}`").cast("string"))
        cell = F.when(v != "", v)
        dated = as_date(cell).isNotNull()
        if spreadsheet:
            dated = dated | (is_number(cell) & cell.try_cast("double").between(SERIAL_LOW, SERIAL_HIGH))
        aggs += [
            F.count(cell).alias(f"{i}_n"),
            F.bool_and(F.lower(cell).isin(*words)).alias(f"{i}_b"),
            F.bool_and(is_number(cell)).alias(f"{i}_f"),
            F.bool_and(F.when(cell.isNotNull(), F.coalesce(dated, F.lit(False)))).alias(f"{i}_d"),
        ]
    items = []
    for i, c in enumerate(columns):
        kind = (
            F.when(F.col(f"{i}_n") == 0, "string").when(F.col(f"{i}_b"), "boolean").when(F.col(f"{i}_f"), "number").when(F.col(f"{i}_d"), "date").otherwise("string")
        )
        items.append(F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), kind.alias("class")))
    return rows.agg(*aggs).select(F.inline(F.array(*items)))


def apply_types(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    return df.select(*[coerce(strip_space(F.col(f"`{c}`").cast("string")), k).alias(c) for c, k in kinds.items()])


# ---- readers -------------------------------------------------------------------------------

def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV as trimmed text columns; rows with another number of fields than the header are dropped.

    Quoted cells may hold line breaks. A file without such cells can be read with ``multi_line=False``, which
    splits it over tasks. Files of a folder or glob must have the same header; another one is an error. Column
    pruning inside the parser is off: with it, a query on few columns would keep the rows that a full read drops.
    """
    options = {"escape": '"', "quote": '"', "multiLine": multi_line, "columnPruning": False}
    head = spark.read.options(header=False, **options).csv(path).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = unique_names([clean_name((h or "").strip() or f"column_{i + 1}") for i, h in enumerate(head)])
    _same_headers(spark, path, [h or "" for h in head], options)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.options(header=True, mode="DROPMALFORMED", **options).schema(schema).csv(path)
    trimmed = rows.select(*[F.coalesce(strip_space(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names])
    return trimmed if len(names) > 1 else trimmed.where(F.col(f"`{names[0]}`") != "")


def _same_headers(spark: SparkSession, path: str, head: Sequence[str], options: Mapping) -> None:
    """The first row of every file equals ``head``. Rows are read unsplit or from the start of a file on, so the
    first of a file is the one with the least running number."""
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(head))] + [T.StructField("_bad", T.StringType())])
    plain = spark.read.options(header=False, columnNameOfCorruptRecord="_bad", **options).schema(schema).csv(path)
    cells = F.array(*[F.coalesce(f"_{i}", F.lit("")) for i in range(len(head))])
    numbered = plain.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), cells.alias("cells"), "_bad")
    first = numbered.where("at = 0").groupBy("file").agg(F.min_by(F.struct("cells", "_bad"), "n").alias("first"))
    other = first.where((F.col("first.cells") != F.array(*map(F.lit, head))) | F.col("first._bad").isNotNull()).select("file").first()
    if other:
        raise ValueError(f"{other['file']} has another header than the first file of {path}")


def load_csv(spark: SparkSession, path: str, sample_rows: int | None = None, zero_one_boolean: bool = True, multi_line: bool = True) -> DataFrame:
    """Typed CSV: read, infer (over all rows unless ``sample_rows`` is given), convert."""
    text = read_csv_text(spark, path, multi_line)
    kinds = {r["column"]: r["class"] for r in infer_types(text, sample_rows=sample_rows, zero_one_boolean=zero_one_boolean).orderBy("position").collect()}
    return apply_types(text, kinds)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.toDF(*unique_names([clean_name(c) for c in df.columns]))


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Load a file, folder or glob by its extension."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "parquet":
        return load_parquet(spark, path)
    if ending in ("csv", "txt"):
        return load_csv(spark, path, **options)
    raise ValueError(f"unsupported file type: {ending}")


# ---- writers -------------------------------------------------------------------------------

def save_table(df: DataFrame, name: str) -> None:
    """Create or replace a table."""
    df.write.mode("overwrite").saveAsTable(clean_name(name))


def table_name(path: str) -> str:
    """Default table name: the file name without its ending, cleaned."""
    return clean_name(path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0], ascii_only=True)


def import_table(spark: SparkSession, path: str, name: str | None = None, **options) -> DataFrame:
    """Load, replace the table (named after the file by default), and return its profile."""
    name = clean_name(name) if name else table_name(path)
    save_table(load(spark, path, **options), name)
    return column_profile(spark.table(name))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes doubled, NULL empty."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def report_rows(title: str, tables: Mapping[str, DataFrame], findings: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: overview, column statistics and findings nested for a JSON report."""
    out = None
    for name, df in tables.items():
        stats = column_profile(df)
        columns = stats.agg(F.array_sort(F.collect_list(F.struct("position", *[c for c in stats.columns if c != "position"]))).alias("statistics"))
        found = findings[name].agg(F.sort_array(F.collect_list(F.struct("insight", "subject", "significance", "metric"))).alias("insights"))
        head = overview(df).select(F.struct("*").alias("overview"))
        keyed = [f.withColumn("table", F.lit(name)) for f in (head, columns, found)]
        row = keyed[0].join(F.broadcast(keyed[1]), "table").join(F.broadcast(keyed[2]), "table")
        out = row if out is None else out.unionByName(row)
    return out.select(F.lit(title).alias("title"), F.current_timestamp().alias("created"), "table", "overview", "statistics", "insights")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
