"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.session import materialize

GROUP_LIMIT = 1000  # Spark's default threshold for limits inside windows
HEAD_KEYS = 100_000  # keys that are sent to the tasks as a table; the others are joined by a shuffle
FEW_ROWS = 500_000


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a NULL key matches a NULL key, as in grouping."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_right_{c}") if c in on else F.col(f"`{c}`") for c in right.columns])
    condition = None
    for c in on:
        same = left[c].eqNullSafe(renamed[f"_right_{c}"])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"_right_{c}" for c in on])


def join_stats(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key statistics to the rows.

    The statistics are written first. Spark then knows their size and sends them to the tasks only if they are
    small; otherwise both sides of the join are plain shuffles, of which it can split the large partitions of a
    hot key. A grouping by the same key inside the join would forbid that.
    """
    return equi_join(big, materialize(small), list(on), how)


def if_few(table: DataFrame, limit: int = FEW_ROWS) -> DataFrame:
    """A written table of few rows is sent to the tasks in a join, so that the other side stays where it is."""
    return F.broadcast(table) if table.count() <= limit else table


def join_frequent(big: DataFrame, stats: DataFrame, key: str, weight: str, head: int = HEAD_KEYS) -> DataFrame:
    """Inner join of a row of ``stats`` per key, for keys of which few hold most rows, as words.

    The keys of the greatest ``weight`` (at least 1) are sent to the tasks, at most ``head`` of them; only the rows of
    the others are shuffled. Both tables are read twice and should be written ones.
    """
    level = F.floor(F.log2(weight))
    levels = stats.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()  # one row per power of two
    held, least = 0, None
    for r in levels:
        held += r["n"]
        if held > head:
            break
        least = r["level"]
    else:
        return big.join(F.broadcast(stats), key)
    if least is None:
        return big.join(stats, key)
    first, others = stats.where(level >= least), stats.where(level < least)
    rare = big.join(F.broadcast(first.select(key)), key, "left_anti")
    return big.join(F.broadcast(first), key).unionByName(rare.join(others, key))


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``stats`` to every row: by key, or as constants when there is no key."""
    if keys:
        return join_stats(df, stats, keys)
    row = stats.first()
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in stats.schema.fields})


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group; ``order`` ends in a unique column.

    Spark cuts each map task's output to ``k`` rows per group before the shuffle as long as ``k`` does
    not exceed its group-limit threshold. Beyond, rows are numbered by a range sort instead.
    """
    if k > GROUP_LIMIT:
        from tablelens.operators.ordering import with_row_index

        placed = with_row_index(df, order, group, name=rank)
        return placed.withColumn(rank, (F.col(rank) + 1).cast("int")).where(F.col(rank) <= k)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
