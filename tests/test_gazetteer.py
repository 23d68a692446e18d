"""Alias search and contained names against brute force, on every layout."""

import random

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import gazetteer as G


def brute(texts, aliases):
    out = []
    for i, t in texts:
        hits = [(-(lv + len(a)), a, target) for a, target, lv in aliases if a and lv is not None and t and a in t]
        out.append((i, *((min(hits)[2], -min(hits)[0]) if hits else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("layout", [{}, {"shard_bytes": 400, "block_bytes": 300}])
def test_alias_match_equals_brute_force(spark, layout):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab县 é") for _ in range(r.randint(0, n)))
    aliases = [(word(5), f"T{i}", r.choice([1, 2, 50, None])) for i in range(120)] + [("ab", "T1", 50), ("ab", "T0", 50), ("", "T", 999)]
    texts = [(i % 90, word(30)) for i in range(200)] + [(1, None), (2, ""), (3, "b" * 5000), (3, "b" * 5000), (None, "ab")]
    df = spark.createDataFrame(texts, "id int, t string").withColumn("alias", F.lit("kept"))
    got = G.alias_match(df, "t", spark.createDataFrame(aliases, "alias string, target string, level int"), **layout)
    assert got.columns == ["id", "t", "alias", "target", "score"]
    assert sorted(((x["id"], x["target"], x["score"]) for x in got.collect()), key=str) == brute(texts, aliases)


def test_empty_gazetteer_and_no_texts(spark):
    none = spark.createDataFrame([], "alias string, target string, level int")
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    assert [tuple(x) for x in G.alias_match(df, "t", none).collect()] == [(1, "a", None, None)]
    one = spark.createDataFrame([("a", None, 1)], "alias string, target string, level int")
    assert [tuple(x) for x in G.alias_match(df, "t", one).collect()] == [(1, "a", None, 2)]
    for layout in ({}, {"shard_bytes": 1}):
        assert G.alias_match(df.limit(0), "t", one, **layout).count() == 0


def test_small_gazetteers_shuffle_no_texts(spark):
    one = spark.createDataFrame([("a", "A", 1)], "alias string, target string, level int")
    plan = G.alias_match(spark.createDataFrame([(1, "a")], "id int, t string"), "t", one)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_contained_names_equal_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("甲乙丙ab") for _ in range(r.randint(0, 6)))
    q = [word() for _ in range(150)] + ["甲甲" + str(i) for i in range(60)] + ["", "a", None]
    c = [word() for _ in range(150)] + ["xx甲甲7yy", "b"]
    a = spark.createDataFrame([(x,) for x in q], "q string")
    b = spark.createDataFrame([(x,) for x in c], "c string")
    got = sorted((x["q"], x["c"]) for x in G.contained_in(a, "q", b, "c", salts=2).collect())
    assert got == sorted((x, y) for x in q for y in c if x and y and x in y)


def test_admin_names(spark):
    a = spark.createDataFrame([("甲市",), ("甲市",), ("乙县",), ("市",), (None,)], "q string")
    b = spark.createDataFrame([("甲县",), ("新甲市区",), ("乙县",), ("市",), (None,)], "c string")
    got = sorted(tuple(x) for x in G.admin_name_match(a, b).collect())
    assert ("甲市", "甲县", "stripped") in got and ("甲市", "新甲市区", "contained") in got and ("乙县", "乙县", "equal") in got and ("市", "市", "equal") in got
    assert len(got) == len(set(got))
