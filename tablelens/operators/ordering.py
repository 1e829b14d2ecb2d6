"""Global order on distributed rows: row index, running counts, order statistics, blocks.

A window without a partition, or partitioned by a key that holds much of the data, runs in one
task. The functions here sort by range instead, count per partition and add the offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.operators.joins import attach_stats, equi_join
from tablelens.session import materialize

BLOCK = 4096
DIRECT_ROWS = 5_000_000
SKETCH_ACCURACY = 10_000


def _as_columns(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition, sort, number the rows inside each partition, and fix the result."""
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    return materialize(placed).withColumn("_pid", F.shiftright("_mono", 33))


def with_row_index(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    keys: Sequence[str] = (),
    name: str = "idx",
    count_name: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row, over all rows or within each key.

    ``order_cols`` must end in a unique column. ``count_name`` also adds the number of rows.
    """
    keys = list(keys)
    rows = _ranged(df, [*_as_columns(keys), *_as_columns(order_cols)])
    # one row per (key, partition): no more than keys + partitions
    parts = rows.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mono").alias("_first"))
    by_key = Window.partitionBy(*keys)
    before = F.sum("_cnt").over(by_key.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    extra = [F.sum("_cnt").over(by_key).alias(count_name)] if count_name else []
    parts = parts.select(*keys, "_pid", (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_shift"), *extra)
    out = equi_join(rows, parts, [*keys, "_pid"])
    tail = [F.col(count_name)] if count_name else []
    return out.select(*df.columns, (F.col("_mono") - F.col("_shift")).alias(name), *tail)


def value_prefix_counts(
    df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Distinct values with their count, the count of smaller ones and the total, per key.

    Rows are combined by value before anything is sorted, so repeated values cost nothing.
    """
    keys = list(keys)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    groups = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("cnt"))
    rows = _ranged(groups, _as_columns([*keys, value]))
    inside = Window.partitionBy(*keys, "_pid")
    rows = rows.withColumn(
        "_run", F.sum("cnt").over(inside.orderBy("_mono").rowsBetween(Window.unboundedPreceding, -1))
    )
    parts = rows.groupBy(*keys, "_pid").agg(F.sum("cnt").alias("_cnt"))
    by_key = Window.partitionBy(*keys)
    before = F.sum("_cnt").over(by_key.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        *keys, "_pid", F.coalesce(before, F.lit(0)).alias("_off"), F.sum("_cnt").over(by_key).alias("total")
    )
    return equi_join(rows, parts, [*keys, "_pid"]).select(
        *keys, value, "cnt", (F.coalesce("_run", F.lit(0)) + F.col("_off")).alias("before"), "total"
    )


def with_running_sum(df: DataFrame, order: str, amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over all rows up to this one; ``order`` is a unique column."""
    rows = _ranged(df.withColumn("_amount", amount), [F.col(order)])
    inside = Window.partitionBy("_pid").orderBy("_mono").rowsBetween(Window.unboundedPreceding, 0)
    # one row per partition
    parts = rows.groupBy("_pid").agg(F.sum("_amount").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy().orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_pid", F.coalesce(before, F.lit(0)).alias("_off"))
    return equi_join(rows.withColumn("_run", F.sum("_amount").over(inside)), parts, ["_pid"]).select(*df.columns, (F.col("_run") + F.col("_off")).alias(name))


def order_stats(
    prefix: DataFrame,
    value: str,
    picks: Mapping[str, Callable[[Column], Column]],
    keys: Sequence[str] = (),
    distinct_name: str | None = None,
) -> DataFrame:
    """Elements at given 0-based ranks. ``picks`` maps a name to a rank as a function of the total.

    ``distinct_name`` also counts the distinct values.
    """
    total = F.col("total")
    hits = {
        name: F.max(F.when((F.col("before") <= rank(total)) & (rank(total) < F.col("before") + F.col("cnt")), F.col(value)))
        for name, rank in picks.items()
    }
    extra = [F.count(F.lit(1)).alias(distinct_name)] if distinct_name else []
    return prefix.groupBy(*keys).agg(*[agg.alias(name) for name, agg in hits.items()], F.max("total").alias("n"), *extra)


def floor_rank(q: float) -> Callable[[Column], Column]:
    """Rank ``floor(n * q)``, kept inside the data."""
    return lambda n: F.least(F.floor(n * F.lit(q)).cast("long"), n - 1)


MEDIAN_LOW: Callable[[Column], Column] = lambda n: F.floor((n - 1) / 2).cast("long")
MEDIAN_HIGH: Callable[[Column], Column] = lambda n: F.floor(n / 2).cast("long")


def order_elements(
    df: DataFrame,
    value: str,
    picks: Mapping[str, tuple[float, Callable[[Column], Column]]],
    keys: Sequence[str] = (),
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Exact elements at given ranks: ``picks`` maps a name to its quantile and its rank.

    Up to ``direct_rows`` rows all values are sorted. Beyond, a quantile sketch first gives bounds
    around each rank; values outside are only counted, and the few inside are sorted. A key whose
    rank lies outside its bounds is sorted in full, so the result is exact either way.
    """
    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    if rows.count() <= direct_rows:
        return order_stats(value_prefix_counts(rows, value, keys), value, {k: rank for k, (_, rank) in picks.items()}, keys)
    return _bracketed_elements(rows, value, picks, list(keys))


def _bracketed_elements(rows: DataFrame, value: str, picks, keys: list[str]) -> DataFrame:
    margin = 2.0 / SKETCH_ACCURACY
    edges = [min(1.0, max(0.0, q + side)) for q, _ in picks.values() for side in (-margin, margin)]
    sketch = F.percentile_approx(value, F.array(*[F.lit(e) for e in edges]), F.lit(SKETCH_ACCURACY))
    bounds = materialize(rows.groupBy(*keys).agg(F.count(value).alias("n"), sketch.alias("_b")))
    placed = attach_stats(rows, bounds, keys)
    v = F.col(value)
    inside = [v.between(F.col("_b")[2 * i], F.col("_b")[2 * i + 1]) for i in range(len(picks))]
    below = placed.groupBy(*keys).agg(*[F.count_if(v < F.col("_b")[2 * i]).alias(f"_below{i}") for i in range(len(picks))])
    hits = F.array_compact(F.array(*[F.when(hit, F.lit(i)) for i, hit in enumerate(inside)]))
    kept = placed.select(*keys, value, F.explode(hits).alias("_pick"))
    prefix = value_prefix_counts(kept, value, [*keys, "_pick"])
    ranked = attach_stats(bounds.drop("_b"), below, keys)
    targets = F.array(*[F.struct(F.lit(i).alias("_pick"), (rank(F.col("n")) - F.col(f"_below{i}")).alias("_rank")) for i, (_, rank) in enumerate(picks.values())])
    goals = ranked.select(*keys, "n", F.inline(targets))
    found = attach_stats(prefix, goals, [*keys, "_pick"]).where((F.col("before") <= F.col("_rank")) & (F.col("_rank") < F.col("before") + F.col("cnt")))
    out = materialize(found.groupBy(*keys).agg(*[F.max(F.when(F.col("_pick") == i, v)).alias(name) for i, name in enumerate(picks)], F.max("n").alias("n")))
    complete = out.dropna(subset=list(picks))
    direct = {k: rank for k, (_, rank) in picks.items()}
    if not keys:
        return complete if not complete.isEmpty() else order_stats(value_prefix_counts(rows, value), value, direct)
    missed = materialize(equi_join(bounds.select(*keys), complete.select(*keys), keys, "left_anti"))
    if missed.isEmpty():
        return complete
    rest = attach_stats(rows, missed.withColumn("_missed", F.lit(True)), keys).where("_missed").drop("_missed")
    return complete.unionByName(order_stats(value_prefix_counts(rest, value, keys), value, direct, keys))


def exact_medians(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median", direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Interpolated median per key (mean of the two middle values for an even count)."""
    picked = order_elements(df, value, {"_lo": (0.5, MEDIAN_LOW), "_hi": (0.5, MEDIAN_HIGH)}, keys, direct_rows)
    return picked.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(name), "n")


def bucketed_rows(df: DataFrame, idx: str, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """Cut an indexed sequence into blocks and copy the edge rows a frame needs.

    A frame of ``before`` preceding and ``after`` following rows can then run per block. ``_own``
    marks the rows that belong to the block; drop the others after the window.
    """
    i = F.col(idx)
    first = F.floor((i - after) / size)
    last = F.floor((i + before) / size)
    return (
        df.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), last.cast("long"))))
        .withColumn("_own", F.floor(i / size).cast("long") == F.col("_block"))
    )


def block_window(keys: Sequence[str], idx: str) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy(idx)


def series_blocks(df: DataFrame, idx: str, value: str, keys: Sequence[str] = (), before: int = 0, size: int = BLOCK) -> DataFrame:
    """Blocks of an indexed series as sorted arrays ``xs`` of ``(i, v, own)``: at most ``size + before`` long."""
    rows = bucketed_rows(df, idx, before, 0, size)
    cell = F.struct(F.col(idx).alias("i"), F.col(value).cast("double").alias("v"), F.col("_own").alias("own"))
    blocks = rows.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(cell)).alias("xs"))
    return blocks.where(F.exists("xs", lambda x: x["own"]))
