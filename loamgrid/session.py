"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "loamgrid", cpus: int | str = "*", **conf) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the session comes from spark-submit."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Where a local session names none a temporary folder is set once; executors elsewhere could not see it.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        path = spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        path = getattr(spark.sparkContext, "_loamgrid_dir", None)
    if not path and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="loamgrid-")
        spark.sparkContext._loamgrid_dir = path
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; nothing is created or removed here."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` once as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per Spark context.

    Needed where the job was not submitted with ``--py-files`` and the workers start elsewhere.
    """
    sc = spark.sparkContext
    if getattr(sc, "_loamgrid_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="loamgrid-pkg-"), "loamgrid")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    sc._loamgrid_shipped = True
