"""Quotas and usage over the event log: users share three keys, one per plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import usage
from tablelens.plans.registry import query, table
from tablelens.session import scratch_path
from tablelens.streaming import usage as stream

_LOG = """lg AS (SELECT event_id, ts, 'key' || user_id % 3 AS key, CASE user_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'team' END AS plan,
    CASE user_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 100 ELSE 500 END AS m, CASE user_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 10000 ELSE 100000 END AS d FROM events),
    mi AS (SELECT *, row_number() OVER (PARTITION BY key, date_trunc('minute', ts) ORDER BY ts, event_id) AS im FROM lg),
    da AS (SELECT *, row_number() OVER (PARTITION BY key, CAST(ts AS DATE) ORDER BY ts, event_id) AS id FROM mi WHERE im <= m),
    ok AS (SELECT *, m - im AS minute_left, d - id AS day_left FROM da WHERE id <= d)"""


def _log(spark, sf):
    third = F.col("user_id") % 3
    plan = F.when(third == 0, "free").when(third == 1, "pro").otherwise("team")
    return table(spark, sf, "events").select("event_id", "ts", F.concat(F.lit("key"), third).alias("key"), plan.alias("plan"))


@query("quota_admission", "U1", f"WITH {_LOG} SELECT event_id, ts, key, plan, CAST(minute_left AS INT) AS minute_left, CAST(day_left AS INT) AS day_left FROM ok")
def quota_admission(spark, sf):
    return usage.admitted_requests(_log(spark, sf), "key", "plan", "ts", "event_id")


@query(
    "quota_report",
    "U1",
    f"""WITH {_LOG}, a AS (SELECT key, CAST(ts AS DATE) AS day, count(*) AS requests FROM lg GROUP BY 1, 2), g AS (SELECT key, CAST(ts AS DATE) AS day, count(*) AS admitted FROM ok GROUP BY 1, 2)
        SELECT key, day, requests, coalesce(admitted, 0) AS admitted, requests - coalesce(admitted, 0) AS rejected FROM a LEFT JOIN g USING (key, day)""",
)
def quota_report(spark, sf):
    return usage.quota_report(_log(spark, sf), "key", "plan", "ts", "event_id")


@query("usage_totals", "U2", f"WITH {_LOG} SELECT key, count(*) AS requests, max(ts) AS last_used FROM lg GROUP BY 1")
def usage_totals(spark, sf):
    return usage.usage_totals(_log(spark, sf), "key", "ts")


@query("usage_per_minute_stream", "U2", "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def usage_per_minute_stream(spark, sf):
    """The log as eight files in no order of time, one to a batch, run as a stream to its end."""
    like = table(spark, sf, "events")
    folder = scratch_path(spark, "log")
    like.repartition(8, "event_id").write.parquet(folder)
    counts = stream.minute_counts(stream.log_stream(spark, folder, "*.parquet", like, files_per_batch=1), "event_type", "ts")
    return stream.run_to_table(counts, ["minute", "event_type"]).select(F.col("minute").cast("timestamp_ntz").alias("minute"), "event_type", "n")


@query("quota_admission_stream", "U1", f"WITH {_LOG} SELECT event_id, ts, key, CAST(minute_left AS INT) AS minute_left, CAST(day_left AS INT) AS day_left FROM ok")
def quota_admission_stream(spark, sf):
    """Admission with state per key and day, over the log as eight files in no order of time, one to a batch."""
    log = _log(spark, sf)
    folder = scratch_path(spark, "log")
    log.repartition(8, "event_id").write.parquet(folder)
    source = stream.log_stream(spark, folder, "*.parquet", log, files_per_batch=1)
    admitted = stream.run_admissions(stream.admissions(source, "key", "plan", "ts", "event_id"))
    plans = log.select("event_id", "plan")  # the numbers left follow from the admitted requests alone
    rows = admitted.withColumnRenamed("tie", "event_id").join(plans, "event_id")
    rows = usage.admitted_requests(rows, "key", "plan", "ts", "event_id")
    return rows.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "key", "minute_left", "day_left")
