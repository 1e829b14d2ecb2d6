import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import joins
from tablelens.operators.ordering import (
    block_window, bucketed_rows, exact_medians, floor_rank, order_elements, series_blocks, value_prefix_counts, with_row_index,
)


def skewed(n=3000, seed=3):
    """A third of the rows in one key, a NULL key, repeated values."""
    rnd = random.Random(seed)
    keys = ["hot"] * (n // 3) + [None] * (n // 10) + [f"k{rnd.randrange(20)}" for _ in range(n - n // 3 - n // 10)]
    return [(k, i, float(rnd.randrange(200))) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, v double").repartition(7, "id")


def by_key(rows):
    out = {}
    for k, i, v in rows:
        out.setdefault(k, []).append((v, i))
    return {k: sorted(x) for k, x in out.items()}


def test_row_index_over_all(df, rows):
    got = {r["id"]: r["idx"] for r in with_row_index(df, ["v", "id"]).collect()}
    want = {i: n for n, (v, i) in enumerate(sorted((v, i) for _, i, v in rows))}
    assert got == want


def test_row_index_per_key_keeps_null_and_hot_keys(df, rows):
    got = {r["id"]: (r["idx"], r["n"]) for r in with_row_index(df, ["v", "id"], ["k"], count_name="n").collect()}
    want = {i: (n, len(g)) for g in by_key(rows).values() for n, (v, i) in enumerate(g)}
    assert got == want


def test_value_prefix_counts(df, rows):
    got = {(r["k"], r["v"]): (r["cnt"], r["before"], r["total"]) for r in value_prefix_counts(df, "v", ["k"]).collect()}
    want = {}
    for k, g in by_key(rows).items():
        values = [v for v, _ in g]
        for v in set(values):
            want[k, v] = (values.count(v), sum(x < v for x in values), len(values))
    assert got == want


@pytest.mark.parametrize("direct_rows", [10**6, 0])
def test_order_elements_exact_on_both_ways(df, rows, direct_rows):
    picks = {"q1": (0.25, floor_rank(0.25)), "mid": (0.5, floor_rank(0.5)), "q3": (0.75, floor_rank(0.75))}
    got = {r["k"]: (r["q1"], r["mid"], r["q3"], r["n"]) for r in order_elements(df, "v", picks, ["k"], direct_rows).collect()}
    want = {k: (*[g[int(len(g) * q)][0] for q in (0.25, 0.5, 0.75)], len(g)) for k, g in by_key(rows).items()}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10])
@pytest.mark.parametrize("direct_rows", [10**6, 0])
def test_medians(spark, n, direct_rows):
    import statistics

    values = [float((7 * i) % 11) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_medians(df, "v", direct_rows=direct_rows).first()["median"] == statistics.median(values)


def test_frames_over_block_edges(spark):
    df = spark.createDataFrame([(i, float(i * i % 17)) for i in range(53)], "idx long, v double")
    w = block_window([], "idx").rowsBetween(-3, 2)
    halo = bucketed_rows(df, "idx", 3, 2, size=5)
    got = {r["idx"]: r["s"] for r in halo.withColumn("s", F.sum("v").over(w)).where("_own").collect()}
    values = [float(i * i % 17) for i in range(53)]
    assert got == {i: sum(values[max(0, i - 3): i + 3]) for i in range(53)}


def test_series_blocks_carry_the_rows_before(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "idx long, v double")
    got = {r["_block"]: [x["i"] for x in r["xs"]] for r in series_blocks(df, "idx", "v", [], 2, size=4).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [2, 3, 4, 5, 6, 7], 2: [6, 7, 8, 9, 10]}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_statistics_join_null_keys_too(spark, df, rows, how):
    small = spark.createDataFrame([("hot", 1.0), ("k3", 2.0), (None, 3.0)], "k string, w double")
    got = [r.asDict() for r in joins.join_stats(df, small, ["k"], how).collect()]
    known = {"hot": 1.0, "k3": 2.0, None: 3.0}
    want = [r for r in rows if how == "left" or (r[0] in known) == (how != "left_anti")]
    assert sorted((r["id"], r.get("w")) for r in got) == sorted((i, known.get(k) if how in ("left", "inner") else None) for k, i, _ in want)


def test_a_key_with_most_rows_is_split(spark):
    """Nine of ten rows are equal; they are dealt to several tasks."""
    rows = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.lit("x" * 50).alias("v"))
    small = rows.groupBy("k").agg(F.count("*").alias("n"))
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        joined = joins.join_stats(rows, small, ["k"]).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.where("k = 'hot'").groupBy("task").count().collect()]
    finally:
        for k in options:
            spark.conf.unset(k)
    assert sum(sizes) == 36_000 and len(sizes) > 2 and max(sizes) < 18_000


def test_top_k_cuts_before_the_shuffle(df):
    top = joins.top_k(df, ["k"], [F.desc("v"), F.asc("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.where(F.col("k") == "hot").count() == 3


@pytest.mark.parametrize("limit", [1000, 2])
def test_top_k_both_ways(df, rows, monkeypatch, limit):
    monkeypatch.setattr(joins, "GROUP_LIMIT", limit)
    got = {(r["id"], r["rank"]) for r in joins.top_k(df, ["k"], [F.asc("v"), F.asc("id")], 3).collect()}
    assert got == {(i, n + 1) for g in by_key(rows).values() for n, (v, i) in enumerate(g[:3])}
