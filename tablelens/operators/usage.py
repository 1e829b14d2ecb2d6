"""Quota admission and usage totals over a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.operators.joins import equi_join

# fixed values: requests per minute and per day of each plan
QUOTAS = {"free": (10, 100), "pro": (100, 10000), "team": (500, 100000)}


def quota(plan: Column, which: int) -> Column:
    """Requests per minute (0) or per day (1) of a plan; NULL for an unknown one."""
    out = F.lit(None).cast("int")
    for name, limits in QUOTAS.items():
        out = F.when(plan == name, F.lit(limits[which])).otherwise(out)
    return out


def admitted_requests(log: DataFrame, key: str, plan: str, ts: str, tie: str) -> DataFrame:
    """Requests inside both quotas of their calendar minute and day.

    A rejected request counts for neither quota, and after a day is used up every later request of
    it is rejected, so numbering by minute first and by day among the survivors is exact. The largest
    minute quota as a constant lets each map task cut a hot minute before the shuffle, and bounds a
    day to that many rows per minute.
    """
    widest = max(m for m, _ in QUOTAS.values())
    rows = log.withColumns({"_minute": F.date_trunc("minute", F.col(ts)), "_day": F.to_date(ts)})
    by_minute = Window.partitionBy(key, "_minute").orderBy(ts, tie)
    kept = rows.withColumn("in_minute", F.row_number().over(by_minute)).where(
        (F.col("in_minute") <= widest) & (F.col("in_minute") <= quota(F.col(plan), 0))
    )
    by_day = Window.partitionBy(key, "_day").orderBy(ts, tie)
    kept = kept.withColumn("in_day", F.row_number().over(by_day)).where(F.col("in_day") <= quota(F.col(plan), 1))
    return kept.withColumns(
        {"minute_left": quota(F.col(plan), 0) - F.col("in_minute"), "day_left": quota(F.col(plan), 1) - F.col("in_day")}
    ).drop("_minute", "_day", "in_minute", "in_day")


def quota_report(log: DataFrame, key: str, plan: str, ts: str, tie: str) -> DataFrame:
    """Requests, admitted and rejected ones per key and day."""
    day = F.to_date(ts).alias("day")
    asked = log.groupBy(key, day).agg(F.count(F.lit(1)).alias("requests"))
    got = admitted_requests(log, key, plan, ts, tie).groupBy(key, day).agg(F.count(F.lit(1)).alias("admitted"))
    both = equi_join(asked, got, [key, "day"], "left").withColumn("admitted", F.coalesce("admitted", F.lit(0)))
    return both.withColumn("rejected", F.col("requests") - F.col("admitted"))


def usage_totals(log: DataFrame, key: str, ts: str) -> DataFrame:
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("requests"), F.max(ts).alias("last_used"))
