"""What is shuffled, and what a task holds, where there are many rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantree import entries_model, entries_studies
from slantree.functions import analysis, metrics
from slantree.operators import ordered


def test_rows_that_repeat_meet_each_other(spark):
    rng = np.random.default_rng(5)
    own = [(int(k), [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=3)]) for k in range(40)]
    rows = [own[k] for k in rng.integers(0, 40, 200)]
    df = spark.createDataFrame(rows, "row_id long, values array<double>").repartition(3)
    got = {(r["a"], r["b"]): r["corr"] for r in analysis.values_correlation(df).collect()}
    long = df.select("row_id", F.posexplode("values").alias("tree_id", "value"))
    long.createOrReplaceTempView("long_values")
    want = spark.sql("select a.tree_id as a, b.tree_id as b, corr(a.value, b.value) as c from long_values a join long_values b on a.row_id = b.row_id and a.tree_id < b.tree_id where a.value is not null and b.value is not null group by all").collect()
    assert len(got) == 3 and got == {(r["a"], r["b"]): pytest.approx(r["c"]) for r in want}
    once = df.distinct()
    assert analysis.repeats(once, "row_id") is None
    met = analysis.prediction_correlation(once.select("row_id", F.posexplode("values").alias("tree_id", "value")))
    apart = {(r["a"], r["b"]): r["corr"] for r in met.collect()}
    assert apart == {(r["a"], r["b"]): pytest.approx(r["corr"]) for r in analysis.values_correlation(once).collect()}


def test_pairs_of_trees_shuffle_no_rows(spark):
    plan = entries_model.tree_pred_correlation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "row_id" not in plan, "only the tasks' sums meet"


def shuffles(df):
    """The widths of the explicit and the planned shuffles of a query, least first."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_trees_of_an_order_are_ranked_where_the_order_is(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_A_TASK", 1000)
    found = shuffles(entries_model.expected_best_of_draws(spark, "/root/testdata/sf0.001"))
    dealt = [x for x in found if "splits" not in x and "n#" not in x.split("),")[0]]
    assert len(dealt) == 1 and "l_orderkey" in dealt[0] and "REPARTITION_BY_NUM" in dealt[0], "one shuffle of the rows"
    assert ", 7)" in dealt[0] or ", 6)" in dealt[0], "parts follow the 6,000 rows"


def test_nulls_are_drawn_last(spark):
    rows = [(1, 3.0), (1, None), (1, 1.0), (2, 5.0)]
    got = {r["g"]: r for r in analysis.expected_best(spark.createDataFrame(rows, "g int, v double"), "g", "v", 2).collect()}
    assert got[1]["expected"] == pytest.approx(1.0 / 9 + 3.0 * 3 / 9) and got[1]["n"] == 3 and got[2]["expected"] == 5.0


def test_families_of_a_node_are_ranked_where_the_node_is(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_A_TASK", 1000)
    df = entries_studies.marginal_value_curves(spark, "/root/testdata/sf0.001")
    found = [x for x in shuffles(df) if "REPARTITION_BY_NUM" in x]
    assert len(found) == 1 and "node" in found[0] and (", 7)" in found[0] or ", 6)" in found[0]), "parts follow the 6,000 rows"
    after = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    below = after[after.index("Generate") :]
    assert "Window" in below and "power" in below.lower(), "draws are summed before they become rows"


@pytest.mark.parametrize("again", [1, 2])
def test_losses_of_rows_that_hold_their_values(spark, again):
    rng = np.random.default_rng(7)
    rows = [(k, k % 2, [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=4)]) for k in range(50)] * again
    df = spark.createDataFrame(rows, "row_id long, y int, values array<double>").repartition(3)

    def loss(f):
        return F.log(1 + F.exp(-f * (2 * F.col("y") - 1)))

    got = {r["tree_id"]: r["loss"] for r in metrics.staged_values(df, loss, init=0.5).collect()}
    long = df.select("row_id", "y", F.posexplode("values").alias("tree_id", "value"))
    assert got == {r["tree_id"]: pytest.approx(r["loss"]) for r in metrics.staged(long, loss, init=0.5).collect()} and len(got) == 4


def test_losses_of_trees_shuffle_no_rows(spark):
    plan = entries_model.staged_loss(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
