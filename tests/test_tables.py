"""Readers, writers, made tables, ordered operators and clashing names."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantree.operators import gradients, ordered, prepare
from slantree.sources import tables


def test_csv_and_results(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"r{k}.csv").write_text(f",dataset,model,accuracy\n0,d{k},m,0.5\n1,d{k},n,0.7\n")
    got = tables.read_csv(spark, str(tmp_path / "r*.csv"), index="_c0")
    assert got.columns == ["dataset", "model", "accuracy"] and got.count() == 4
    assert tables.read_csv(spark, str(tmp_path), pattern="r1.csv").count() == 2
    with gzip.open(tmp_path / "plain.csv.gz", "wt") as f:
        f.write("1,2\n3,4\n5,6\n")
    assert tables.read_csv(spark, str(tmp_path / "plain.csv.gz"), header=False, limit=2).count() == 2
    tables.write_results(got, str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 4
    text = tables.markdown(got, ["model"], ["accuracy"])
    assert "| m | 0.5000±0.0000 |" in text
    assert tables.summary_lines(got, "model", "accuracy") == ["m: mean 0.5000, best 0.5000, worst 0.5000, n 2", "n: mean 0.7000, best 0.7000, worst 0.7000, n 2"]


def test_parameters(spark, tmp_path):
    tables.write_params({"a": {"depth": 3}, "b": {}}, str(tmp_path / "p.json"), spark)
    assert tables.read_params(spark, str(tmp_path / "p.json"), "a") == {"depth": 3}
    assert tables.read_params(spark, str(tmp_path / "p.json"), "zzz") == {}


def test_gain_log(spark, tmp_path):
    log = spark.createDataFrame([(0, 0, 50, "axis", 1.0), (0, 0, 50, "block", 2.0), (1, 1, 20, "axis", 0.5)], "node_seq int, depth int, ns int, family string, gain double")
    tables.write_results(log, str(tmp_path / "log"))
    got = {r["node_seq"]: r["gains"] for r in tables.read_gain_log(spark, str(tmp_path / "log")).collect()}
    assert got == {0: {"axis": [1.0], "block": [2.0]}, 1: {"axis": [0.5]}}


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_quantiles_and_cuts(spark, descending):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 300, 2000) / 10
    df = spark.createDataFrame([(f"k{k:05d}", float(v)) for k, v in enumerate(x)], "k string, x double").repartition(5)
    got = {r["x"]: r["run_n"] for r in ordered.running(df.groupBy("x").agg(F.count("*").alias("n")), "x", ["n"], descending, parts=7).collect()}
    assert got == {v: int((x >= v).sum() if descending else (x <= v).sum()) for v in set(x)}
    assert np.allclose(ordered.quantiles(df, "x", [0.0, 0.25, 0.5, 0.99, 1.0]), np.quantile(x, [0.0, 0.25, 0.5, 0.99, 1.0]))
    order = sorted(range(len(x)), key=lambda k: (-x[k] if descending else x[k], k))
    for n in (0, 1, 777, 2000, 5000):
        want = {f"k{k:05d}" for k in order[:n]}
        assert {r["k"] for r in df.where(ordered.first_n(df, n, "x", "k", descending)).collect()} == want


def test_odd_tables(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert ordered.quantiles(none, "x", [0.5]) == [None]
    assert gradients.goss(none, "x", "k", 0.2, 0.1).count() == 0
    assert gradients.stride(spark.range(10), "id", 10, 20).count() == 10
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "v string, id int")
    got = sorted((r["id"], r["code"]) for r in prepare.encode(df, "v", prepare.dictionary(df.where("v = 'a'"), "v"), "code").collect())
    assert got == [(1, 0), (2, 1), (3, 1)], "an input column id stays"


def test_made_table(spark):
    got = prepare.made_table(spark, 500, 4, 2).agg(F.count("*"), F.avg("y")).first()
    assert got[0] == 500 and 0.3 < got[1] < 0.7
