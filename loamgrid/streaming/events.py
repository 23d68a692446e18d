"""Stream operators over event, log and file streams. Each takes and returns a (streaming) DataFrame.

Late data: rows older than the watermark are dropped; their number is in the query progress.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loamgrid.functions.text import progress_of

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def session_expiry(events: DataFrame, client: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a client that end when no heartbeat comes for the gap (append mode)."""
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), client).agg(F.count("*").alias("beats"), F.max(ts).alias("last_beat"))
    return w.select(client, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "beats", "last_beat")


def heartbeat_last_seen(events: DataFrame, client: str = "user_id", ts: str = "ts") -> DataFrame:
    """Latest heartbeat per client (update mode); the state is one timestamp per client."""
    return events.groupBy(client).agg(F.max(ts).alias("last_seen"), F.count("*").alias("beats"))


def stream_progress(logs: DataFrame, task: str = "task", line: str = "line") -> DataFrame:
    """Progress per task that never decreases and stays at 99 until done (update mode)."""
    p = logs.select(task, progress_of(F.col(line)).alias("p")).filter(F.col("p").isNotNull())
    return p.groupBy(task).agg(F.least(F.max("p"), F.lit(99)).alias("progress"))


def dedupe_stream(events: DataFrame, keys: list[str], ts: str = "ts", horizon: str = "1 hour") -> DataFrame:
    """First occurrence of a key within the horizon wins; state expires with the watermark."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def tumbling_composite(events: DataFrame, by: str, value: str, ts: str = "ts", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Composite per period and key."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), by)
    a = w.agg(F.avg(value).alias("mean"), F.max(value).alias("mx"), F.min(value).alias("mn"), F.count("*").alias("n"))
    return a.select(F.col("w.start").alias("period"), by, "mean", (F.col("mx") - F.col("mn")).alias("spread"), "n")


def ingest_recent_files(spark: SparkSession, path: str, schema: str, max_age: str = "24h", glob: str = "[!._]*.json", fmt: str = "json", per_trigger: int = 1000) -> DataFrame:
    """Files not older than the age limit (against the newest file); partial and hidden names are skipped."""
    r = spark.readStream.schema(schema).format(fmt).option("maxFileAge", max_age).option("pathGlobFilter", glob)
    return r.option("maxFilesPerTrigger", per_trigger).load(path).withColumn("file", F.col("_metadata.file_path"))


def stalled_tasks(logs: DataFrame, now: Column, interval: str = "10 minutes", task: str = "task", ts: str = "ts") -> DataFrame:
    """Batch form: tasks whose last log line is older than the interval."""
    last = logs.groupBy(task).agg(F.max(ts).alias("last_seen"))
    return last.filter(F.col("last_seen") < now - F.expr(f"interval {interval}"))


#: Buckets of tasks whose runs are one value of the state store.
TASK_BUCKETS = 1 << 10


class StallTimer(StatefulProcessor):
    """Per bucket of tasks the runs of lines of a task that are less than the interval apart, and one event-time timer at
    the end of the first.

    A late line may lengthen a run, bridge two or start one between them, so runs stay until the watermark has passed their
    end by the interval: then no line that is still accepted can touch them, and the stall is reported. The state is the
    name of the task and two numbers a run, and only runs younger than the watermark less the interval are held. Calls to
    the state store cost far more than runs, so all runs of a bucket are one value.
    """

    def __init__(self, interval_ms: int):
        self.interval = interval_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "tasks array<string>, starts array<bigint>, ends array<bigint>, due bigint")

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        tasks, starts, ends, due = self.runs.get() if self.runs.exists() else ([], [], [], None)
        return _runs(list(tasks), list(starts), list(ends)), due

    def _keep(self, runs: pd.DataFrame, due: int | None) -> None:
        """Stores the runs; ``due`` is the timer that is set."""
        # Timers take milliseconds: the first one that is not before the end of the interval.
        first = -(-(int(runs["end"].min()) + self.interval) // 1000) if len(runs) else None
        if due is not None and due != first:
            self.handle.deleteTimer(due)
        if first is None:
            self.runs.clear()
            return
        if due != first:
            self.handle.registerTimer(first)
        self.runs.update((runs["task"].tolist(), runs["start"].tolist(), runs["end"].tolist(), first))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        runs, due = self._held()
        for r in rows:
            new = r.loc[r["us"].notna(), ["task", "us"]].drop_duplicates()
            us = new["us"].astype("int64").tolist()
            runs = join_task_runs(pd.concat([runs, _runs(new["task"].tolist(), us, us)]), self.interval)
        if len(runs):
            self._keep(runs, due)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        runs, _ = self._held()
        over = runs["end"] + self.interval <= now
        self._keep(runs[~over], None)  # the timer that has gone off is no longer set
        if over.any():
            yield runs.loc[over, ["task", "end"]].rename(columns={"end": "last_us"})

    def close(self) -> None:
        pass


def _runs(tasks: list, starts: list[int], ends: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"task": pd.Series(tasks, dtype=object), "start": pd.Series(starts, dtype="int64"), "end": pd.Series(ends, dtype="int64")})


def join_task_runs(runs: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Intervals of a task less than ``gap`` apart become one; ordered by task and time."""
    if not len(runs):
        return runs
    code, names = pd.factorize(runs["task"], use_na_sentinel=False)
    start, end = runs["start"].to_numpy(), runs["end"].to_numpy()
    order = np.lexsort((start, code))
    code, start, end = code[order], start[order], end[order]
    until = pd.Series(end).groupby(code).cummax().to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (start[1:] - until[:-1] >= gap)]))
    tasks = [None if pd.isna(v) else v for v in names]
    return _runs([tasks[c] for c in code[first]], start[first].tolist(), np.maximum.reduceat(end, first).tolist())


def join_runs(starts: list[int], ends: list[int], gap: int) -> tuple[list[int], list[int]]:
    """Intervals of one task."""
    runs = join_task_runs(_runs([0] * len(starts), starts, ends), gap)
    return runs["start"].tolist(), runs["end"].tolist()


def stalled_stream(logs: DataFrame, interval_ms: int, late: str = "1 minute", task: str = "task", ts: str = "ts") -> DataFrame:
    """Stream form of :func:`stalled_tasks`: every time a task had no line for the interval, with its last line before it.

    Emitted once the watermark has passed the interval, whatever the triggers; lines up to ``late`` behind the newest one
    count as if they had come in time. Needs the RocksDB state store (``with_rocksdb``).
    """
    s = logs.withWatermark(ts, late).filter(F.col(ts).isNotNull())
    s = s.select(F.pmod(F.xxhash64(task), F.lit(TASK_BUCKETS)).alias("bucket"), F.col(task).cast("string").alias("task"), ts, F.unix_micros(ts).alias("us"))
    ended = s.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=StallTimer(interval_ms), outputStructType="task string, last_us long", outputMode="append", timeMode="eventTime"
    )
    return ended.select(F.col("task").cast(logs.schema[task].dataType).alias("task"), F.timestamp_micros("last_us").alias("last_seen"))


@contextmanager
def with_rocksdb(spark: SparkSession):
    """The state store that stateful processors need, for queries started inside; the session's own choice comes back."""
    old = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, old) if old else spark.conf.unset(STATE_STORE)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "json", mode: str = "append"):
    """File sink with a checkpoint: exactly once; runs over what is there, then stops."""
    return df.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Upsert-style sink for update mode; the batch number makes repeats harmless."""
    return df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
