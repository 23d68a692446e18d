"""Queries: streams replayed from the event table through file sinks, and their batch twins in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.plans.registry import query
from loamgrid.plans.text import LOGSQL, logs
from loamgrid.plans.views import table
from loamgrid.session import scratch_path
from loamgrid.streaming import events as E

r6 = lambda c, n: F.round(c, 6).alias(n)


def _events(spark, sf):
    """Watermarks want an instant, the table holds local times: both are read in the session's zone."""
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _local(df, *cols):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else c for c in df.columns])


def _source(spark, sf, df=None):
    """The event table as a stream: written once to the shared folder, read as files.

    One sentinel row far in the future closes all windows, as the next day's data would.
    """
    path = scratch_path(spark, "stream-in")
    e = _events(spark, sf) if df is None else df
    e.write.parquet(path)
    return spark.readStream.schema(e.schema).parquet(path), path


def _closing(spark, sf):
    """The event table and the closing row as a stream. Its files are in no order of time, so a replay reads them in
    one trigger: with several, the lateness of an operator must cover the disorder of its source.
    """
    e = _events(spark, sf)
    path = scratch_path(spark, "stream-in")
    e.write.parquet(path)
    last = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(1)
    end = last.select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    end.write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).parquet(path), path


def _drain(spark, df, mode="append"):
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    q = E.write_stream(df, out, ck, "parquet", mode)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _drain_update(spark, df, keys):
    """Update mode: batches append to a table; the last version of each key is the result."""
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")

    def sink(batch, n):
        batch.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    E.run_batches(df, sink, ck).awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    t = spark.read.parquet(out).groupBy(*keys).agg(F.max(F.struct("__batch", *rest)).alias("v"))
    return t.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


@query(
    "session_expiry",
    """with l as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as sid from l)
select user_id, min(ts) as session_start, max(ts) + interval 6 hours as session_end, count(*) as beats, max(ts) as last_beat from s group by user_id, sid""",
)
def q_session(spark, sf):
    src, _ = _closing(spark, sf)
    s = _drain(spark, E.session_expiry(src, gap="6 hours")).filter("user_id >= 0")
    return _local(s, "session_start", "session_end", "last_beat")


@query("heartbeat_last_seen", "select user_id, max(ts) as last_seen, count(*) as beats from events group by 1")
def q_beat(spark, sf):
    src, _ = _source(spark, sf)
    return _local(_drain_update(spark, E.heartbeat_last_seen(src), ["user_id"]), "last_seen")


@query("stream_progress", f"with {LOGSQL} select task, least(max(p), 99) as progress from lg where p is not null group by 1")
def q_progress(spark, sf):
    src, _ = _source(spark, sf, logs(spark, sf))
    return _drain_update(spark, E.stream_progress(src), ["task"])


@query("stream_step_audit", f"with {LOGSQL} select task, event_id, line from lg")
def q_audit(spark, sf):
    src, _ = _source(spark, sf, logs(spark, sf))
    out, ck = scratch_path(spark, "audit"), scratch_path(spark, "audit-ck")
    E.write_stream(src.select("task", "event_id", "line"), out, ck).awaitTermination()
    return spark.read.schema("task bigint, event_id bigint, line string").json(out)


@query("ingest_recent_files", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def q_ingest(spark, sf):
    path = scratch_path(spark, "captured")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    src = E.ingest_recent_files(spark, path, "event_id bigint, event_type string, value double")
    return _drain(spark, src).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("dedupe_stream", "select distinct user_id, event_type from events")
def q_dedupe(spark, sf):
    src, _ = _source(spark, sf)
    return _drain(spark, E.dedupe_stream(src, ["user_id", "event_type"], horizon="60 days")).select("user_id", "event_type")


@query("tumbling_year", "select date_trunc('day', ts) as period, event_type, round(avg(value), 6) as mean, round(max(value) - min(value), 6) as spread, count(*) as n from events group by 1, 2")
def q_tumbling(spark, sf):
    src, _ = _closing(spark, sf)
    d = _drain(spark, E.tumbling_composite(src, "event_type", "value")).filter("event_type <> 'end'")
    return _local(d, "period").select("period", "event_type", r6("mean", "mean"), r6("spread", "spread"), "n")


@query("stalled_tasks", "select user_id as task, max(ts) as last_seen from events group by 1 having max(ts) < (select max(ts) from events) - interval 4 hours")
def q_stalled(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("task"), "ts")
    return E.stalled_tasks(e, e.select(F.max("ts")).scalar(), "4 hours")


STALL_PARTS = 2


@query(
    "stalled_tasks_stream",
    """with l as (select user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as nx from events)
select user_id as task, ts as last_seen from l where nx is null or nx - ts >= interval 4 hours""",
)
def q_stalled_stream(spark, sf):
    """The event table in parts by time, one trigger each, every tenth line a part late; a last line closes all runs."""
    e = _events(spark, sf).select(F.col("user_id").alias("task"), "ts", "event_id")
    first, last = e.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    if first is None:
        return spark.createDataFrame([], "task bigint, last_seen timestamp_ntz")
    step = (last - first) / STALL_PARTS + 1.0
    part = F.floor((F.col("ts").cast("double") - first) / step) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    e = e.withColumn("part", part)
    late = 2 * step + 1  # a part late is at most two parts behind the newest line
    path, ck, out = (scratch_path(spark, n) for n in ("stall-in", "stall-ck", "stall-out"))
    end = spark.range(1).select(F.lit(-1).cast("bigint").alias("task"), F.lit(last + late + 2 * 86400.0).cast("timestamp").alias("ts"))
    with E.with_rocksdb(spark):
        for n in range(STALL_PARTS + 2):
            now = e.filter(F.col("part") == n).select("task", "ts") if n <= STALL_PARTS else end
            now.write.mode("append").parquet(path)
            src = spark.readStream.schema("task bigint, ts timestamp").parquet(path)
            E.write_stream(E.stalled_stream(src, 4 * 3_600_000, f"{int(late)} seconds"), out, ck, "parquet").awaitTermination()
    got = spark.read.schema("task bigint, last_seen timestamp").parquet(out).filter("task >= 0")
    return got.select("task", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))
