"""Writers: tables, raster cells, reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODATA = -9999.0


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_raster_cells(cells: DataFrame, path: str, kind: str = "float", mode: str = "overwrite") -> None:
    """One folder per layer; missing is -9999 in a float layer and 255 in a mask.

    Rows are range-ordered inside each file, so a window read skips row groups.
    """
    v = F.coalesce("value", F.lit(NODATA)) if kind == "float" else F.coalesce(F.col("value").cast("int"), F.lit(255))
    out = cells.withColumn("value", v)
    out.repartitionByRange("layer", "row").sortWithinPartitions("layer", "row", "col").write.mode(mode).partitionBy("layer").parquet(path)


def read_raster_cells(spark, path: str, nodata: float = NODATA) -> DataFrame:
    return spark.read.parquet(path).withColumn("value", F.nullif(F.col("value"), F.lit(nodata)))


def write_json_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str, fmt: str = "json") -> None:
    write_table(df, path, fmt, "append")
