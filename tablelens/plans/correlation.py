"""Correlation and regression on the test tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablelens.operators import correlation as corr
from tablelens.plans.registry import query, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART = ["p_partkey", "p_size", "p_retailprice"]

ERF_SQL = """(1 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t
             + 0.254829592::DOUBLE) * t * exp(-x * x))"""


# two-sided t tail for whole degrees of freedom n - 2 as a finite sum in sin = |r| and cos^2 = 1 - r^2
SMALL_SQL = """CASE WHEN n % 2 = 0
    THEN 1 - abs(r) * coalesce(list_sum(list_transform(range(0, CAST((n - 2) // 2 AS BIGINT)),
        lambda j: gamma(2 * j + 1) / (gamma(j + 1) * gamma(j + 1) * pow(4, j)) * pow(1 - r * r, j))), 0)
    ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * coalesce(list_sum(list_transform(range(0, CAST((n - 3) // 2 AS BIGINT)),
        lambda j: pow(4, j) * gamma(j + 1) * gamma(j + 1) / gamma(2 * j + 2) * pow(1 - r * r, j))), 0)) END"""


def p_sql(source: str) -> str:
    """``source`` (.., r, n) with the p-value: normal tail from 30 degrees of freedom on, exact sum below."""
    return f"""SELECT * EXCLUDE (x, t), CASE WHEN n < 3 THEN 1 WHEN abs(r) >= 1 THEN 0 WHEN n - 2 >= 30 THEN greatest(0, 1 - {ERF_SQL}) ELSE {SMALL_SQL} END AS p FROM (
        SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM (
        SELECT *, abs(r) * sqrt((n - 2) / nullif(1 - r * r, 0)) / sqrt(2) AS x FROM ({source})))"""


def pairs_sql(name: str, columns: list[str], rank: bool = False) -> str:
    """Unrounded pairs (i, j, col1, col2, r, p, n)."""
    parts = []
    for i, j in combinations(range(len(columns)), 2):
        a, b = columns[i], columns[j]
        src = f"(SELECT {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM {name} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        if rank:
            src = f"""(SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS a,
                              rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS b FROM {src})"""
        parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS col1, '{b}' AS col2, corr(a, b) AS r, count(*) AS n FROM {src}")
    return p_sql(' UNION ALL '.join(parts))


R3 = "floor({0} * 1000 + 0.5) / 1000"


def list_sql(name: str, columns: list[str], rank: bool = False) -> str:
    return f"""SELECT col1, col2, r, p, n, p < 0.05 AND abs(r) > 0.3 AS significant FROM (
        SELECT col1, col2, {R3.format('r')} AS r, {R3.format('p')} AS p, n FROM ({pairs_sql(name, columns, rank)}))"""


@query("pearson_quantity_price", "C1 C4", f"SELECT col1, col2, {R3.format('r')} AS r, {R3.format('p')} AS p, n FROM ({pairs_sql('lineitem', LINE[:2])})")
def pearson_quantity_price(spark, sf):
    return corr.rounded(corr.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query(
    "average_rank_of_size",
    "C2",
    """SELECT DISTINCT p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rank,
              count(*) OVER (PARTITION BY p_size) AS cnt FROM part""",
)
def average_rank_of_size(spark, sf):
    return corr.average_ranks(table(spark, sf, "part"), "p_size")


@query("spearman_size_price", "C3", f"SELECT col1, col2, {R3.format('r')} AS r, {R3.format('p')} AS p, n FROM ({pairs_sql('part', PART[1:], True)})")
def spearman_size_price(spark, sf):
    return corr.rounded(corr.spearman(table(spark, sf, "part"), "p_size", "p_retailprice"))


@query("spearman_pairs", "C3 C6", list_sql("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"], True))
def spearman_pairs(spark, sf):
    return corr.pair_list(table(spark, sf, "supplier"), ["s_suppkey", "s_nationkey", "s_acctbal"], "spearman")


@query(
    "correlation_p_values",
    "C4",
    f"SELECT col1, col2, round(p, 6) AS p FROM ({pairs_sql('lineitem', LINE)})",
)
def correlation_p_values(spark, sf):
    return corr.correlation_pairs(table(spark, sf, "lineitem"), LINE).select("col1", "col2", F.round("p", 6).alias("p"))


_PER_NATION = """SELECT s_nationkey, 's_suppkey' AS col1, 's_acctbal' AS col2, count(*) AS n,
    CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(corr(s_suppkey, s_acctbal), 0) END AS r FROM supplier GROUP BY s_nationkey"""


@query("correlation_p_small_samples", "C4", f"SELECT s_nationkey, col1, col2, round(r, 6) AS r, round(p, 6) AS p, n FROM ({p_sql(_PER_NATION)})")
def correlation_p_small_samples(spark, sf):
    """Per nation, where the supplier groups have few rows: the incomplete-beta branch."""
    out = corr.pearson(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal", ["s_nationkey"])
    return out.withColumns({"r": F.round("r", 6), "p": F.round("p", 6)})


def matrix_sql(name: str, columns: list[str]) -> str:
    p = pairs_sql(name, columns)
    diagonal = " UNION ALL ".join(f"SELECT {i}, {i}, '{c}', '{c}', 1.0::DOUBLE, 0.0::DOUBLE" for i, c in enumerate(columns))
    return f"""WITH pr AS ({p}) SELECT i, j, col1, col2, r, p FROM pr UNION ALL SELECT j, i, col2, col1, r, p FROM pr UNION ALL {diagonal}"""


@query("correlation_matrix", "C5", f"SELECT i, j, col1, col2, {R3.format('r')} AS r, {R3.format('p')} AS p FROM ({matrix_sql('lineitem', LINE)})")
def correlation_matrix(spark, sf):
    return corr.rounded(corr.correlation_matrix(table(spark, sf, "lineitem"), LINE))


@query("correlation_pair_list", "C6 C12", list_sql("part", PART))
def correlation_pair_list(spark, sf):
    return corr.correlate_table(table(spark, sf, "part"))


@query(
    "correlation_labels",
    "C7",
    f"""SELECT col1, col2, r, CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate'
               WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'very weak' END AS strength,
               CASE WHEN r > 0.05 THEN 'positive' WHEN r < -0.05 THEN 'negative' ELSE 'none' END AS direction
        FROM ({list_sql('part', PART)})""",
)
def correlation_labels(spark, sf):
    return corr.labelled(corr.pair_list(table(spark, sf, "part"), PART)).select("col1", "col2", "r", "strength", "direction")


@query(
    "correlation_heatmap",
    "C8",
    f"SELECT j AS x_pos, 3 - i AS y_pos, col1, col2, {R3.format('r')} AS r FROM ({matrix_sql('lineitem', LINE)})",
)
def correlation_heatmap(spark, sf):
    return corr.heatmap_cells(corr.correlation_matrix(table(spark, sf, "lineitem"), LINE), len(LINE))


@query(
    "correlation_summary",
    "C6 C9",
    f"""SELECT count(*) AS pairs, count(*) FILTER (WHERE significant) AS significant_pairs,
               round(count(*) FILTER (WHERE significant) / count(*), 4) AS significant_share,
               count(*) FILTER (WHERE abs(r) > 0.7) AS strong_pairs, count(*) FILTER (WHERE r < -0.4) AS negative_pairs
        FROM ({list_sql('part', PART)})""",
)
def correlation_summary(spark, sf):
    return corr.pair_summary(corr.pair_list(table(spark, sf, "part"), PART))


@query(
    "correlation_top_pairs",
    "C9",
    f"SELECT * FROM ({list_sql('lineitem', ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', *LINE])}) ORDER BY abs(r) DESC, col1, col2 LIMIT 10",
)
def correlation_top_pairs(spark, sf):
    return corr.top_pairs(corr.pair_list(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE]))


@query(
    "regression_price_on_quantity",
    "C10",
    """SELECT count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2,
              round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, round(stddev_pop(x), 4) AS sd_x, round(stddev_pop(y), 4) AS sd_y,
              round(corr(x, y), 6) AS r,
              CASE WHEN abs(corr(x, y)) > 0.7 THEN 'strong' WHEN abs(corr(x, y)) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength
       FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)""",
)
def regression_price_on_quantity(spark, sf):
    out = corr.regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    four = ("slope", "intercept", "mean_x", "mean_y", "sd_x", "sd_y")
    return out.withColumns({**{c: F.round(c, 4) for c in four}, "r2": F.round("r2", 6), "r": F.round("r", 6)})


@query(
    "index_regression_per_type",
    "C11",
    """SELECT event_type, count(*) AS n, round(regr_slope(value, i), 8) AS slope, round(regr_intercept(value, i), 4) AS intercept,
              round(regr_r2(value, i), 6) AS r2, round(avg(value), 4) AS mean
       FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY event_type""",
)
def index_regression_per_type(spark, sf):
    out = corr.index_regression(table(spark, sf, "events"), "value", ["ts", "event_id"], ["event_type"])
    return out.withColumns({"slope": F.round("slope", 8), "intercept": F.round("intercept", 4), "r2": F.round("r2", 6), "mean": F.round("mean", 4)})


