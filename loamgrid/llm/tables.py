"""Intermediate tables of multi-step operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loamgrid.session import scratch_path

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str, codec: str = "zstd", file_rows: int = 0) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back; the shuffle files behind it are no longer needed and go.

    Files hold at most ``file_rows`` rows (0: what a task has).
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).option("maxRecordsPerFile", file_rows).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.parquet(path)
    out._settled_at = path
    return out


def slices(df: DataFrame, most: int) -> list[DataFrame]:
    """A settled table in up to ``most`` tables of whole files; any other table as it is."""
    files = sorted(df.inputFiles()) if getattr(df, "_settled_at", None) else []
    n = min(most, len(files))
    return [df.sparkSession.read.schema(df.schema).parquet(*files[i::n]) for i in range(n)] if n > 1 else [df]


def release(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
