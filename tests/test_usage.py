import datetime as dt
import random

from tablelens.operators import usage
from tablelens.operators.usage import QUOTAS


def simulate(log):
    """One request after the other with plain counters."""
    minute, day, kept = {}, {}, set()
    for i, key, plan, ts in sorted(log, key=lambda r: (r[3], r[0])):
        m, d = (key, ts.replace(second=0, microsecond=0)), (key, ts.date())
        if minute.get(m, 0) < QUOTAS[plan][0] and day.get(d, 0) < QUOTAS[plan][1]:
            minute[m] = minute.get(m, 0) + 1
            day[d] = day.get(d, 0) + 1
            kept.add(i)
    return kept


def test_admission_against_a_simulation(spark):
    rnd = random.Random(1)
    start = dt.datetime(2024, 1, 1, 23, 50)
    log = []
    for i in range(4000):
        key = "hot" if i % 3 else f"k{i % 5}"
        plan = {"hot": "pro", "k0": "free", "k1": "free", "k2": "team", "k3": "pro", "k4": "free"}[key]
        log.append((i, key, plan, start + dt.timedelta(seconds=rnd.randrange(1200) if i % 2 else rnd.randrange(60))))
    df = spark.createDataFrame(log, "id long, key string, plan string, ts timestamp_ntz").repartition(6)
    got = usage.admitted_requests(df, "key", "plan", "ts", "id")
    assert {r["id"] for r in got.collect()} == simulate(log)
    report = usage.quota_report(df, "key", "plan", "ts", "id").collect()
    assert sum(r["requests"] for r in report) == 4000
    assert sum(r["admitted"] for r in report) == len(simulate(log))
    assert all(r["rejected"] == r["requests"] - r["admitted"] for r in report)


def test_a_hot_minute_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "k", "free", dt.datetime(2024, 1, 1))], "id long, key string, plan string, ts timestamp_ntz")
    plan = usage.admitted_requests(df, "key", "plan", "ts", "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_files_out_of_order_lose_nothing_unless_asked(spark, tmp_path):
    import pytest

    from tablelens.streaming import usage as stream

    start = dt.datetime(2024, 1, 1)
    for i, minute in enumerate((50, 0, 30, 10)):
        rows = [("k", start + dt.timedelta(minutes=minute, seconds=s)) for s in range(3)]
        spark.createDataFrame(rows, "key string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    like = spark.read.parquet(str(tmp_path / "log"))
    source = lambda: stream.log_stream(spark, str(tmp_path / "log"), "*.parquet", like, files_per_batch=1)
    got = stream.run_to_table(stream.minute_counts(source(), "key", "ts"), ["minute", "key"]).collect()
    assert sorted((r["minute"].minute, r["n"]) for r in got) == [(0, 3), (10, 3), (30, 3), (50, 3)]
    with pytest.raises(RuntimeError):
        stream.run_to_table(stream.minute_counts(source(), "key", "ts", late="1 minute"), ["minute", "key"])


def _stream_log(spark, folder, rows, parts):
    schema = "id long, key string, plan string, ts timestamp_ntz"
    for i in parts:
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_admits_the_same_requests_also_after_a_restart(spark, tmp_path):
    from tablelens.streaming import usage as stream

    rnd, start, log = random.Random(2), dt.datetime(2024, 1, 1, 23, 50), []
    for i in range(2400):
        key = "hot" if i % 3 else f"k{i % 5}"
        plan = {"hot": "pro", "k0": "free", "k1": "free", "k2": "team", "k3": "pro", "k4": "free"}[key]
        log.append((i, key, plan, start + dt.timedelta(seconds=rnd.randrange(1200) if i % 2 else rnd.randrange(60))))
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    like = spark.createDataFrame([], "id long, key string, plan string, ts timestamp_ntz")

    def run():
        source = stream.log_stream(spark, folder, "*.parquet", like, files_per_batch=1)
        return {r["tie"] for r in stream.run_admissions(stream.admissions(source, "key", "plan", "ts", "id"), out).collect()}

    _stream_log(spark, folder, log, (0, 1))
    assert run() == simulate(log[0::4] + log[1::4])
    _stream_log(spark, folder, log, (2, 3))
    assert run() == simulate(log)


def test_stream_state_goes_as_time_passes(spark, tmp_path):
    import pytest

    from tablelens.streaming import usage as stream

    start, folder = dt.datetime(2024, 1, 1, 10), str(tmp_path / "log")
    schema = "id long, key string, plan string, ts timestamp_ntz"
    like = spark.createDataFrame([], schema)
    log = [(i, "k", "free", start + dt.timedelta(hours=12 * (i // 40), minutes=i % 40 // 20, seconds=i % 20)) for i in range(160)]
    log += [(900, "k", None, start), (901, "k", "other", start), (902, "k", "free", None)]
    source = lambda: stream.log_stream(spark, folder, "*.parquet", like, files_per_batch=1)
    out = str(tmp_path / "out")
    for part in range(4):
        spark.createDataFrame(log[part * 40 : part * 40 + 40] + (log[160:] if part == 0 else []), schema).coalesce(1).write.mode("append").parquet(folder)
        got = stream.run_admissions(stream.admissions(source(), "key", "plan", "ts", "id", late="1 hour"), out)
    assert {r["tie"] for r in got.collect()} == simulate(log[:160])
    spark.createDataFrame([log[0]], schema).coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(RuntimeError):
        stream.run_admissions(stream.admissions(source(), "key", "plan", "ts", "id", late="1 hour"), out)
