"""Request counts per key and minute, and admission by quotas, from a stream of log files."""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from tablelens.operators.usage import quota
from tablelens.session import scratch_path

DAY_MS = 24 * 60 * 60 * 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log_stream(spark: SparkSession, folder: str, file_filter: str, like: DataFrame, files_per_batch: int = 64) -> DataFrame:
    """Stream the parquet files of a folder that match ``file_filter``."""
    return (
        spark.readStream.schema(like.schema)
        .option("pathGlobFilter", file_filter)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def minute_counts(stream: DataFrame, key: str, ts: str, late: str | None = None) -> DataFrame:
    """Tumbling one-minute counts per key.

    Without ``late`` every row counts, in whatever order the files come; the state keeps all windows. With it,
    the state keeps the windows of that long, and ``run_to_table`` fails if a row comes later than that.
    """
    timed = stream.select(F.col(key), F.col(ts).cast("timestamp").alias("_ts"))
    timed = timed.withWatermark("_ts", late) if late else timed
    return (
        timed.groupBy(F.window("_ts", "1 minute").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("minute"), key, "n")
    )


def _drain(rows: DataFrame, out: str, name: str) -> None:
    """Process what is there into ``out/data``; an error if rows came too late for the state.

    Each batch overwrites its own folder, so a batch that is run again after a failure leaves one
    copy; the checkpoint lies in the shared folder too, and a later call goes on where this one ended.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    dropped: list[int] = []

    class Watch(StreamingQueryListener):
        run = None

        def onQueryStarted(self, event):
            if event.name == label:
                self.run = event.runId

        def onQueryProgress(self, event):
            if event.progress.runId == self.run:
                dropped.extend(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

        def onQueryTerminated(self, event):
            if event.runId == self.run:
                done.set()

    label, watch, done = f"{name}-{uuid.uuid4().hex}", Watch(), threading.Event()
    spark.streams.addListener(watch)
    query = (
        rows.writeStream.outputMode("update")
        .foreachBatch(write)
        .queryName(label)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
        if not done.wait(60):  # progress reports come before the end, in order
            raise RuntimeError("the stream ended without its last reports, so rows may have been dropped unseen")
    finally:
        spark.streams.removeListener(watch)
    if sum(dropped):
        raise RuntimeError(f"{sum(dropped)} rows came later than the stream waits for")


def run_to_table(counts: DataFrame, keys: list[str], name: str = "minute-counts") -> DataFrame:
    """Process what is there and return the latest count per key; an error if rows came too late to count."""
    out = scratch_path(counts.sparkSession, name)
    _drain(counts, out, name)
    return counts.sparkSession.read.parquet(f"{out}/data").groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


class _Admission(StatefulProcessor):
    """Requests of one key and day inside both quotas so far, as changes: 1 admitted, -1 taken back.

    Of a minute the first requests up to its quota are held, and of the day those before its quota is used up. A
    request that falls behind either never comes back, since earlier requests only push it further, so nothing else
    is kept. When the watermark passes a minute its requests are final and only their number stays; when it passes
    the day the state goes.
    """

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "minute long", "at array<long>, tie array<long>")
        self.counts = handle.getMapState("counts", "minute long", "n long")

    def _load(self, minute: int) -> list[tuple[int, int]]:
        if not self.held.containsKey((minute,)):
            return []
        return list(zip(*map(list, self.held.getValue((minute,)))))

    def _store(self, minute: int, rows: list[tuple[int, int]]) -> None:
        if rows:
            self.held.updateValue((minute,), ([a for a, _ in rows], [t for _, t in rows]))
            self.counts.updateValue((minute,), (len(rows),))
        else:
            self.held.removeKey((minute,))
            self.counts.removeKey((minute,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before: dict[int, list] = {}
        now: dict[int, list] = {}
        per_day = None
        for frame in rows:
            if frame.empty:
                continue
            if frame["per_day"].nunique() > 1 or per_day not in (None, int(frame["per_day"].iloc[0])):
                raise ValueError(f"key {key[0]} has more than one plan in a day")
            per_day = int(frame["per_day"].iloc[0])
            for minute, part in frame.groupby("minute"):
                minute = int(minute)
                if minute not in now:
                    before[minute] = now[minute] = self._load(minute)
                fresh = zip(part["at"].tolist(), part["tie"].tolist())
                now[minute] = sorted([*now[minute], *fresh])[: int(part["per_minute"].iloc[0])]
        if per_day is None:
            return
        used = 0
        sizes = {k[0]: v[0] for k, v in self.counts.iterator()} | {m: len(r) for m, r in now.items()}
        for minute in sorted(sizes):
            left = max(0, per_day - used)
            if sizes[minute] > left:
                if minute not in now:
                    before[minute] = now[minute] = self._load(minute)
                now[minute] = now[minute][:left]
            used += min(sizes[minute], left)
        change: Counter = Counter()
        for minute, kept in now.items():
            change.update(kept)
            change.subtract(before[minute])
            self._store(minute, kept)
            if self.timed:
                self.handle.registerTimer(minute // 1000 + 60_000)
        if self.timed:
            self.handle.registerTimer(_day_end(min(now)))
        moved = [(key[0], at, tie, n) for (at, tie), n in change.items() if n]
        yield pd.DataFrame(moved, columns=["key", "at", "tie", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at % DAY_MS == 0:
            self.held.clear()
            self.counts.clear()
        else:
            self.held.removeKey((at * 1000 - 60_000_000,))
        return iter(())

    def close(self) -> None:
        pass


def _day_end(minute: int) -> int:
    """The end of the day (UTC) in milliseconds; ``minute`` in microseconds."""
    return (minute // 1000 // DAY_MS + 1) * DAY_MS


def admissions(stream: DataFrame, key: str, plan: str, ts: str, tie: str, late: str | None = None) -> DataFrame:
    """Changes ``key, at, tie, change`` of the admitted requests, with one state per key and day.

    Files may come in any order: a request is taken back (-1) when earlier ones of its minute or day turn up. ``tie``
    is a unique whole number, a key has one plan, days are those of UTC; rows without a known plan or a time are not
    admitted. Without ``late`` the state stays; with it, it goes as time passes, and rows later than that are an error.
    """
    at = F.col(ts).cast("timestamp")
    # names that begin with an underscore do not reach the processor
    rows = stream.select(
        F.col(key).alias("key"), at.alias("asked"), F.col(tie).cast("long").alias("tie"), F.unix_micros(at).alias("at"),
        quota(F.col(plan), 0).cast("long").alias("per_minute"), quota(F.col(plan), 1).cast("long").alias("per_day"),
    ).where(F.col("asked").isNotNull() & F.col("per_day").isNotNull())
    rows = rows.withColumns({"minute": F.col("at") - F.pmod("at", F.lit(60_000_000)), "day": F.floor(F.col("at") / F.lit(1000 * DAY_MS))})
    rows = rows.withWatermark("asked", late) if late else rows
    ddl = f"key {stream.schema[key].dataType.simpleString()}, at long, tie long, change int"
    return rows.groupBy("key", "day").transformWithStateInPandas(_Admission(late is not None), ddl, "Update", "EventTime" if late else "None")


def run_admissions(changes: DataFrame, out: str | None = None, name: str = "admissions") -> DataFrame:
    """Process what is there and return ``key, ts, tie`` of the requests that stand admitted.

    With the same ``out`` again, the stream goes on from its checkpoint with the files that are new.
    """
    spark = changes.sparkSession
    out = out or scratch_path(spark, name)
    setting = "spark.sql.streaming.stateStore.providerClass"
    former = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)  # the store that such state needs; read when the stream starts
    try:
        _drain(changes, out, name)
    finally:
        spark.conf.set(setting, former)
    rows = spark.read.parquet(f"{out}/data").groupBy("key", "at", "tie").agg(F.sum("change").alias("n")).where("n > 0")
    return rows.select("key", F.timestamp_micros("at").alias("ts"), "tie")
