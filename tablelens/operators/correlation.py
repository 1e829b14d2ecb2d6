"""Pearson and Spearman correlation with p-values, matrices, simple regression."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.functions.stats import p_value, round_half_up
from tablelens.operators.joins import join_stats
from tablelens.operators.ordering import value_prefix_counts, with_row_index
from tablelens.operators.profile import columns_of

SIGNIFICANT_P, SIGNIFICANT_R = 0.05, 0.3


def correlation_from_moments(n: Column, cov: Column, sx: Column, sy: Column) -> Column:
    """r, or 0 with fewer than three pairs or a constant side."""
    return F.when((n >= 3) & (sx > 0) & (sy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, sx * sy)))).otherwise(F.lit(0.0))


def _pair_moments(x: Column, y: Column, prefix: str) -> list[Column]:
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return [
        F.count(px).alias(f"{prefix}_n"),
        F.covar_pop(px, py).alias(f"{prefix}_c"),
        F.stddev_pop(px).alias(f"{prefix}_sx"),
        F.stddev_pop(py).alias(f"{prefix}_sy"),
    ]


def correlation_pairs(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """All pairs ``col1 < col2`` by position: ``r``, ``p``, ``n`` on pairwise complete rows, one scan."""
    values = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = list(combinations(range(len(columns)), 2))
    aggs = [m for i, j in pairs for m in _pair_moments(F.col(f"c{i}"), F.col(f"c{j}"), f"{i}_{j}")]
    wide = values.groupBy(*keys).agg(*aggs)
    items = [
        F.struct(
            F.lit(columns[i]).alias("col1"),
            F.lit(columns[j]).alias("col2"),
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.col(f"{i}_{j}_n").alias("n"),
            correlation_from_moments(*[F.col(f"{i}_{j}_{m}") for m in ("n", "c", "sx", "sy")]).alias("r"),
        )
        for i, j in pairs
    ]
    rows = wide.select(*keys, F.inline(F.array(*items)))
    return rows.withColumn("p", p_value(F.col("r"), F.col("n")))


def pearson(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """``r`` and two-sided ``p`` of two columns, unrounded."""
    return correlation_pairs(df, [x, y], keys).select(*keys, "col1", "col2", "r", "p", "n")


def rounded(pairs: DataFrame, places: int = 3) -> DataFrame:
    return pairs.withColumns({"r": round_half_up("r", places), "p": round_half_up("p", places)})


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """1-based rank of each distinct value, ties at their mean rank."""
    prefix = value_prefix_counts(df, value, keys)
    return prefix.select(*keys, value, (F.col("before") + (F.col("cnt") + 1) / 2).alias("rank"), "cnt")


def ranked_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Ranks of both columns on the rows where both are present."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    # equal pairs share both ranks, so they travel as one weighted row
    pairs = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    rx = average_ranks(both, "x").select("x", F.col("rank").alias("rx"))
    ry = average_ranks(both, "y").select("y", F.col("rank").alias("ry"))
    return join_stats(join_stats(pairs, rx, ["x"]), ry, ["y"])


def _weighted_correlation(ranked: DataFrame) -> DataFrame:
    """Rank correlation of weighted rows. Both rank columns have mean (n + 1) / 2."""
    total = ranked.agg(F.sum("w")).first()[0] or 0
    mid = (total + 1) / 2
    dx, dy, w = F.col("rx") - mid, F.col("ry") - mid, F.col("w")
    sums = ranked.agg(F.sum(w * dx * dy).alias("c"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    ok = (F.lit(total) >= 3) & (F.col("xx") > 0) & (F.col("yy") > 0)
    r = F.when(ok, F.try_divide(F.col("c"), F.sqrt("xx") * F.sqrt("yy"))).otherwise(F.lit(0.0))
    return sums.select(r.alias("r"), F.lit(total).cast("long").alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = _weighted_correlation(ranked_pairs(df, x, y))
    return rows.select(F.lit(x).alias("col1"), F.lit(y).alias("col2"), "r", p_value(F.col("r"), F.col("n")).alias("p"), "n")


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = None
    for i, j in combinations(range(len(columns)), 2):
        row = spearman(df, columns[i], columns[j]).withColumns({"i": F.lit(i), "j": F.lit(j)})
        out = row if out is None else out.unionByName(row)
    return out


def pairs_by_method(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method}")
    return correlation_pairs(df, columns) if method == "pearson" else spearman_pairs(df, columns)


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Full matrix in long form ``(i, j, col1, col2, r, p)``, diagonal 1."""
    pairs = pairs_by_method(df, columns, method).select("i", "j", "col1", "col2", "r", "p")
    mirror = pairs.select(
        F.col("j").alias("i"), F.col("i").alias("j"), F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r", "p"
    )
    diagonal = df.sparkSession.createDataFrame(
        [(i, i, c, c, 1.0, 0.0) for i, c in enumerate(columns)], "i int, j int, col1 string, col2 string, r double, p double"
    )
    return pairs.unionByName(mirror).unionByName(diagonal)


def heatmap_cells(matrix: DataFrame, size: int) -> DataFrame:
    """Matrix cells with the row order reversed, for a -1..1 colour scale."""
    return matrix.select(F.col("j").alias("x_pos"), (F.lit(size - 1) - F.col("i")).alias("y_pos"), "col1", "col2", round_half_up("r", 3).alias("r"))


def with_significance(pairs: DataFrame, alpha: float = SIGNIFICANT_P) -> DataFrame:
    return pairs.withColumn("significant", (F.col("p") < alpha) & (F.abs("r") > SIGNIFICANT_R))


def pair_list(df: DataFrame, columns: Sequence[str], method: str = "pearson", alpha: float = SIGNIFICANT_P) -> DataFrame:
    """Pairs by decreasing strength with a significance flag."""
    pairs = with_significance(rounded(pairs_by_method(df, columns, method)), alpha)
    return pairs.orderBy(F.desc(F.abs("r")), "i", "j").select("col1", "col2", "r", "p", "n", "significant")


def strength_label(r: Column) -> Column:
    size = F.abs(r)
    return (
        F.when(size >= 0.9, "very strong").when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").otherwise("very weak")
    )


def direction_label(r: Column) -> Column:
    return F.when(r > 0.05, "positive").when(r < -0.05, "negative").otherwise("none")


def labelled(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"strength": strength_label(F.col("r")), "direction": direction_label(F.col("r"))})


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Counts over a flagged pair list: all, significant, strong, negative."""
    n = F.count(F.lit(1))
    hits = F.count_if("significant")
    return pairs.agg(
        n.alias("pairs"),
        hits.alias("significant_pairs"),
        F.round(F.try_divide(hits.cast("double"), n.cast("double")), 4).alias("significant_share"),
        F.count_if(F.abs("r") > 0.7).alias("strong_pairs"),
        F.count_if(F.col("r") < -0.4).alias("negative_pairs"),
    )


def top_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc(F.abs("r")), "col1", "col2").limit(n)


def regression(df: DataFrame, x: str, y: str, min_pairs: int = 10) -> DataFrame:
    """Least squares of ``y`` on ``x`` with the correlation of both; an error under ``min_pairs``."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    out = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"),
        F.stddev_pop("x").alias("sd_x"),
        F.stddev_pop("y").alias("sd_y"),
        F.covar_pop("x", "y").alias("_c"),
    )
    r = correlation_from_moments(F.col("n"), F.col("_c"), F.col("sd_x"), F.col("sd_y"))
    enough = F.when(F.col("n") < min_pairs, F.raise_error(F.lit(f"regression needs at least {min_pairs} pairs")).cast("double")).otherwise(r)
    label = F.when(F.abs("r") > 0.7, "strong").when(F.abs("r") > 0.4, "moderate").otherwise("weak")
    return out.withColumn("r", enough).drop("_c").withColumn("strength", label)


def index_regression(df: DataFrame, value: str, order_by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Least squares of a series on its index 0..n-1, per key; slope and R2 are 0 on a constant."""
    rows = with_row_index(df.where(F.col(value).isNotNull()).select(*keys, *order_by, value), order_by, keys)
    return regression_on_index(rows, value, keys)


def regression_on_index(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    i = F.col("idx").cast("double")
    v = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.coalesce(F.regr_slope(v, i), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(v, i), F.avg(v)).alias("intercept"),
        F.coalesce(F.when(F.stddev_pop(v) > 0, F.regr_r2(v, i)), F.lit(0.0)).alias("r2"),
        F.avg(v).alias("mean"),
    )


def correlate_table(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    """Flagged pair list over the numeric columns; at least two columns and three rows."""
    columns = list(columns or columns_of(df, "number"))
    if len(columns) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    if len(df.select(*columns).take(3)) < 3:
        raise ValueError("correlation needs at least three rows")
    return pair_list(df, columns, method)
