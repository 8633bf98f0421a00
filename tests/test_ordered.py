"""Cuts over whole tables: ties, key types, repeated keys, nulls; both ways of the search."""

import random

import pytest
from pyspark.sql import functions as F

from slantree.operators import gradients, ordered


def chosen(df, n, descending=False, small=10):
    mark = ordered.first_n(df, n, "v", "k", descending=descending, small=small)
    return df.where(mark)


@pytest.mark.parametrize("small", [10, 100_000])
@pytest.mark.parametrize("kind", ["long", "int", "double", "string"])
def test_first_n_of_many_ties(spark, kind, small):
    rows = spark.range(-500, 2500).select((F.col("id") * 7919 + (F.col("id") % 3) * (1 << 40 if kind == "long" else 1)).cast(kind).alias("k"), F.lit(1.5).alias("v"))
    for n in (1, 700, 2999):
        got = [r["k"] for r in chosen(rows, n, small=small).collect()]
        want = sorted((r["k"] for r in rows.collect()), key=lambda k: k.encode() if kind == "string" else k)[:n]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("small", [5, 100_000])
def test_first_n_against_a_sort(spark, descending, small):
    rng = random.Random(4)
    rows = [(rng.choice([None, float("nan"), -1e300, 0.0, 1.0, 1.0, 2.5, rng.random(), 1e9]), rng.randrange(40), k) for k in range(400)]
    df = spark.createDataFrame(rows, "v double, k long, row int").repartition(3)

    def place(r):
        v = r[0]
        return (v is None or v != v, 0 if v is None or v != v else -v if descending else v, r[1])

    for n in (1, 57, 200, 399):
        got = chosen(df, n, descending, small).collect()
        assert len(got) == n
        assert sorted(place(r) for r in got) == sorted(map(place, rows))[:n]


def test_rows_equal_in_all_columns_share_their_fate(spark):
    df = spark.createDataFrame([(1.0, 7)] * 6 + [(0.5, 1)], "v double, k long")
    assert chosen(df, 1).count() == 1 and chosen(df, 3).count() == 7


def test_goss_of_one_score(spark):
    df = spark.range(30_000).withColumn("s", F.lit(0.5))
    got = gradients.goss(df, "s", "id", 0.7, 0.1)
    assert got.where("amplify = 1").count() == 21_000 and got.where("amplify <> 1").count() == 900
    assert got.where("amplify = 1").agg(F.max("id")).first()[0] == 20_999


def test_goss_of_null_scores(spark):
    df = spark.range(100).withColumn("s", F.lit(None).cast("double"))
    assert gradients.goss(df, "s", "id", 0.2, 0.1).count() == 20 + 8
    assert gradients.goss(df.limit(0), "s", "id", 0.2, 0.1).count() == 0
