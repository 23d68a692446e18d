"""Encodings that only show late in a file, skewed folds, gazetteers, streams in several triggers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loamgrid.operators.validation import _lightest, group_kfold
from loamgrid.session import scratch_path
from loamgrid.sources import files as S
from loamgrid.streaming import events as E


def late_gbk(spark):
    path = scratch_path(spark, "late")
    os.makedirs(path)
    with open(f"{path}/a.csv", "wb") as f:
        f.write(b"lon,lat,som\n" + b"".join(b"%d,2,plain\n" % i for i in range(300)) + "7,8,土壤有机质\n".encode("gbk"))
    return path


def test_late_text_keeps_its_encoding(spark):
    path = late_gbk(spark)
    df, enc, sep = S.scan_csv_best(spark, path)
    assert df.filter("lat = '8'").first()["som"] == "土壤有机质" and sep == "," and enc.startswith(("gb", "cp936"))
    assert S.read_table_simple(spark, path).filter("lat = '8'").first()["som"] == "土壤有机质"


def test_simple_reader_finds_the_separator(spark):
    path = scratch_path(spark, "semi")
    os.makedirs(path)
    with open(f"{path}/a.csv", "w") as f:
        f.write("a;b\n1;2\n")
    assert S.read_table_simple(spark, path).columns == ["a", "b"]


@pytest.mark.parametrize("seed", range(4))
def test_folds_equal_the_greedy_rule(spark, seed):
    r = random.Random(seed)
    size = {g: r.choice([1, 1, 1, 2, 3, 17, 40]) for g in range(60)}
    load, want = [0] * 5, {}
    for g in sorted(size, key=lambda g: (-size[g], g)):
        f = load.index(min(load))
        want[g], load[f] = f, load[f] + size[g]
    df = spark.createDataFrame([(g,) for g, n in size.items() for _ in range(n)], "g int")
    assert {x["g"]: x["fold"] for x in group_kfold(df, "g").collect()} == want
    assert sum(_lightest([5, 0, 9], 2, 7)) == 7


def test_sessions_over_several_triggers(spark):
    path, out, ck = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    base = spark.range(600).select((F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    for part in (3, 0, 5, 1, 4, 2):
        base.filter(F.floor(F.unix_timestamp("ts") / 6000) == part).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(-1,)], "user_id bigint").select("user_id", F.timestamp_seconds(F.lit(10**9)).alias("ts")).write.mode("append").parquet(path)
    src = spark.readStream.schema("user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = E.session_expiry(src, gap="30 minutes", late="1 day")
    E.write_stream(got, out, ck, "parquet", "append").awaitTermination()
    assert spark.read.schema(got.schema).parquet(out).filter("user_id >= 0").agg(F.sum("beats")).first()[0] == 600


def test_a_file_without_line_ends_in_an_encoding_is_no_line_of_its_length(spark, monkeypatch):
    monkeypatch.setattr(S, "PROBE_CHARS", 400)
    path = scratch_path(spark, "probe-gbk")
    S.allow_all_charsets(spark)
    rows = spark.range(3000).select(F.col("id").alias("点号"), (F.col("id") % 90).alias("经度"), (F.col("id") % 40).alias("纬度"), F.lit("7 g/kg").alias("有机质"))
    rows.coalesce(1).write.csv(path, header=True, sep=";", encoding="GBK")
    cols = S.probe_candidates(spark, path).select("encoding", F.length(F.concat_ws("", "cols")).alias("n")).collect()
    assert len(cols) > 20 and max(r["n"] for r in cols) <= 400
    df, enc, sep = S.scan_csv_best(spark, path)
    assert (df.count(), enc, sep) == (3000, "gb18030", ";")
