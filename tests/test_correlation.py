import pytest
from pyspark.sql import functions as F

from tablelens.functions.stats import p_value, t_two_sided
from tablelens.operators import correlation as c


# two-sided critical values of the t distribution at 5 and 1 percent
@pytest.mark.parametrize("df,t,p", [(1, 12.706, 0.05), (3, 3.182, 0.05), (5, 2.571, 0.05), (10, 2.228, 0.05), (10, 3.169, 0.01), (29, 2.045, 0.05), (29, 0.683, 0.5), (60, 2.0, 0.0455)])
def test_t_tail(spark, df, t, p):
    got = spark.range(1).select(t_two_sided(F.lit(t), F.lit(float(df))).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=4e-4)


def test_p_value_limits(spark):
    rows = spark.createDataFrame([(0.0, 50), (1.0, 9), (0.9, 2)], "r double, n long").select(p_value(F.col("r"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in rows] == [1.0, 0.0, 1.0]


def test_constant_column_gives_zero(spark):
    df = spark.createDataFrame([(float(i), 5.0, None if i == 2 else float(-i)) for i in range(8)], "a double, b double, c double")
    got = {(r["col1"], r["col2"]): (r["r"], r["p"], r["n"]) for r in c.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == (0.0, 1.0, 8)
    assert got["a", "c"][0] == pytest.approx(-1.0) and got["a", "c"][2] == 7


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, 20.0, 20.0, 30.0, 30.0, 30.0)], "v double")
    assert {r["v"]: r["rank"] for r in c.average_ranks(df, "v").collect()} == {10.0: 1.0, 20.0: 2.5, 30.0: 5.0}


def test_spearman_of_a_monotone_curve_is_one(spark):
    df = spark.createDataFrame([(float(i), float(i**3)) for i in range(20)] + [(1.0, None)], "x double, y double")
    row = c.spearman(df, "x", "y").first()
    assert row["r"] == pytest.approx(1.0) and row["n"] == 20


def test_regression_needs_ten_pairs(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(12)], "x double, y double")
    row = c.regression(df, "x", "y").first()
    assert (row["slope"], row["intercept"], row["strength"]) == (pytest.approx(3.0), pytest.approx(1.0), "strong")
    with pytest.raises(Exception, match="at least 10 pairs"):
        c.regression(df.limit(5), "x", "y").collect()


def test_table_needs_two_columns_and_three_rows(spark):
    with pytest.raises(ValueError):
        c.correlate_table(spark.createDataFrame([(1.0,)], "a double"))
    with pytest.raises(ValueError):
        c.correlate_table(spark.createDataFrame([(1.0, 2.0)], "a double, b double"))
