import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from loamgrid.session import scratch_path
from loamgrid.streaming import events as E


def source(spark, rows):
    path = scratch_path(spark, "in")
    df = spark.createDataFrame(rows, "task long, ts timestamp, line string")
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path), path, df.schema


def at(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def test_late_rows_are_dropped_after_the_watermark(spark):
    src, path, schema = source(spark, [(1, at(0), "a"), (1, at(200), "b")])
    ck, out = scratch_path(spark, "ck"), scratch_path(spark, "out")
    s = E.session_expiry(src, "task", gap="10 minutes", late="5 minutes")
    E.write_stream(s, out, ck, "parquet").awaitTermination()
    spark.createDataFrame([(1, at(1), "late"), (1, at(500), "end")], schema).coalesce(1).write.mode("append").parquet(path)
    E.write_stream(s, out, ck, "parquet").awaitTermination()
    got = sorted((r["session_start"], r["beats"]) for r in spark.read.parquet(out).collect())
    assert [b for _, b in got] == [1, 1]


def test_stalls_do_not_depend_on_triggers_and_late_lines(spark):
    lines = [(1, 0), (1, 20), (1, 45), (1, 100), (2, 0), (2, 29), (2, 59), (2, 89), (3, 10), (3, 40), (3, 41), (None, 5)]
    want = sorted([(1, 45), (1, 100), (2, 29), (2, 59), (2, 89), (3, 10), (3, 41), (None, 5)], key=str)
    arrivals = [
        [lines],
        [[(1, 0), (1, 45), (2, 0), (3, 10), (3, 41), (None, 5)], [(1, 20), (2, 29), (2, 59), (3, 40)], [(1, 100), (2, 89)]],
    ]
    for parts in arrivals:
        src, path, schema = source(spark, [(t, at(m), "") for t, m in parts[0]])
        ck, out = scratch_path(spark, "ck"), scratch_path(spark, "out")
        with E.with_rocksdb(spark):
            for part in [*parts[1:], [(9, 1000)], None]:
                E.write_stream(E.stalled_stream(src, 30 * 60_000, "2 hours"), out, ck, "parquet").awaitTermination()
                if part:
                    spark.createDataFrame([(t, at(m), "") for t, m in part], schema).coalesce(1).write.mode("append").parquet(path)
        rows = spark.read.schema("task long, last_seen timestamp").parquet(out).select("task", F.unix_micros("last_seen").alias("us")).collect()
        zero = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
        assert sorted([(r["task"], (r["us"] - zero) / 60_000_000) for r in rows], key=str) == [(t, float(m)) for t, m in want]


def test_runs_join_across_late_lines():
    assert E.join_runs([0, 50, 20], [10, 60, 45], 15) == ([0], [60])
    assert E.join_runs([0, 50, 20], [10, 60, 45], 10) == ([0, 20], [10, 60])
    assert E.join_runs([0, 20], [10, 30], 11) == ([0], [30])
    assert E.join_runs([], [], 5) == ([], [])


def test_batch_stall(spark):
    df = spark.createDataFrame([(1, at(0)), (2, at(55))], "task long, ts timestamp")
    got = E.stalled_tasks(df, F.lit(at(60)).cast("timestamp"), "30 minutes").collect()
    assert [r["task"] for r in got] == [1]


def test_runs_of_a_bucket_are_one_value():
    runs = E._runs(["a", None, "b", "a", None, "a"], [0, 5, 50, 20, 9, 90], [10, 6, 60, 45, 9, 95])
    got = E.join_task_runs(runs, 15)
    assert sorted(map(tuple, got.itertuples(index=False)), key=repr) == sorted([("a", 0, 45), (None, 5, 9), ("b", 50, 60), ("a", 90, 95)], key=repr)

    class Store:
        value, timers = None, set()
        exists, get, update, clear = (lambda s: s.value is not None), (lambda s: s.value), (lambda s, v: setattr(s, "value", v)), (lambda s: setattr(s, "value", None))
        getValueState, registerTimer, deleteTimer = (lambda s, *a: s), (lambda s, t: s.timers.add(t)), (lambda s, t: s.timers.remove(t))
        getExpiryTimeInMs = getCurrentWatermarkInMs = lambda s: s.now

    store, timer = Store(), E.StallTimer(10)
    timer.init(store)
    lines = pd.DataFrame({"task": ["a", "b", "b"], "us": [1_000_000, 2_000_000, 2_009_000]})
    assert list(timer.handleInputRows((0,), iter([lines]), None)) == [] and store.timers == {1010}
    store.timers, store.now = set(), 1010  # it has gone off
    assert pd.concat(timer.handleExpiredTimer((0,), store, store)).values.tolist() == [["a", 1_000_000]] and store.timers == {2019}
    store.timers, store.now = set(), 2019
    assert pd.concat(timer.handleExpiredTimer((0,), store, store)).values.tolist() == [["b", 2_009_000]]
    assert store.value is None and not store.timers


def test_null_tasks_take_no_stall_of_others(spark):
    lines = [(t if t % 7 else None, (t * 37 + k * k * 13) % 3000) for t in range(400) for k in range(6)]
    want = set()
    for task in {t for t, _ in lines}:
        mine = sorted({m for t, m in lines if t == task})
        want |= {(task, a) for a, b in zip(mine, [*mine[1:], 10**9]) if b - a >= 30}
    src, path, schema = source(spark, [(t, at(m), "") for t, m in lines])
    ck, out = scratch_path(spark, "ck"), scratch_path(spark, "out")
    with E.with_rocksdb(spark):
        E.write_stream(E.stalled_stream(src, 30 * 60_000, "1 minute"), out, ck, "parquet").awaitTermination()
        spark.createDataFrame([(9, at(9000), "")], schema).coalesce(1).write.mode("append").parquet(path)
        E.write_stream(E.stalled_stream(src, 30 * 60_000, "1 minute"), out, ck, "parquet").awaitTermination()
    rows = spark.read.schema("task long, last_seen timestamp").parquet(out).collect()
    assert sorted([(r["task"], r["last_seen"]) for r in rows], key=str) == sorted([(t, at(m)) for t, m in want], key=str)
