"""Trees of other shapes against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slantree.plans import shapes
from slantree.plans.shapes import ObliviousTree, exact_tree, oblivious_tree
from slantree.plans.trees import route


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": rng.normal(size=700).round(2), "b": rng.integers(0, 9, 700).astype(float)})
    frame["g0"] = -np.where(frame.a + 0.3 * frame.b > 1, 1.0, -0.5) + 0.1 * rng.normal(size=700)
    frame["h0"] = 1.0
    return frame, spark.createDataFrame(frame).persist()


def best_cut(frame, steps, lam=1.0):
    def score(s):
        return 0.5 * s.g0.sum() ** 2 / (s.h0.sum() + lam)

    found = None
    for f in "ab":
        own = frame.sort_values(f)
        step, values = max(1, len(own) // steps), np.unique(own[f])
        for v, nxt in zip(values, values[1:]):
            n, before = (own[f] <= v).sum(), (own[f] < v).sum()
            if n // step > before // step:
                left = own[own[f] <= v]
                gain = score(left) + score(own[own[f] > v]) - score(own)
                if found is None or gain > found[0] + 1e-12:
                    found = (gain, f, (v + nxt) / 2)
    return found


@pytest.mark.parametrize("steps", [64, 1000])
def test_exact_tree(rows, steps):
    frame, df = rows
    tree = exact_tree(df, ["a", "b"], 2, steps=steps).nodes
    at = route(tree, frame[["a", "b"]].to_numpy(), np.zeros(2))
    for t in (0, 1, 2):
        inside = np.isin(at, [t, 2 * t + 1, 2 * t + 2]) if t else np.ones(len(at), bool)
        gain, f, edge = best_cut(frame[inside], steps)
        assert tree[t].gain == pytest.approx(gain) and "ab"[tree[t].w.index(1.0)] == f and tree[t].threshold == pytest.approx(edge)
    for t, n in tree.items():
        if n.is_leaf:
            assert n.leaf[0] == pytest.approx(-frame.g0[at == t].sum() / ((at == t).sum() + 1), abs=1e-7)


def test_exact_tree_without_cuts(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1.0)] * 10, "a double, g0 double, h0 double")
    assert exact_tree(df, ["a"], 3).nodes[0].is_leaf
    assert exact_tree(df.limit(0), ["a"], 3).nodes[0].leaf == [0.0]


@pytest.mark.parametrize("shared", [False, True])
def test_oblivious_tree_is_fitted_stored_and_scored(spark, rows, tmp_path, shared):
    frame, df = rows
    tree = oblivious_tree(df, ["a", "b"], [[1.0, 0.0], [0.0, 1.0], [1.0, 0.3]], 3, shared)
    assert len(tree.directions) == 3 and len(tree.leaves) == 8 and [len(t) for t in tree.thresholds] == ([1, 1, 1] if shared else [1, 2, 4])
    tree.save(spark, str(tmp_path / "t"))
    again = ObliviousTree.load(spark, str(tmp_path / "t"))
    assert again == tree
    code = np.zeros(len(frame), int)
    for w, edges in zip(tree.directions, tree.thresholds):
        p = frame.a * w[0] + frame.b * w[1]
        edge = np.array([np.inf if e is None else e for e in edges])
        code = 2 * code + (p >= (edge[0] if len(edge) == 1 else edge[code])).astype(int)
    got = df.select(again.code().alias("c"), again.score().alias("s")).toPandas()
    assert got.c.tolist() == code.tolist() and np.allclose(got.s, np.array(tree.leaves)[code])
    for c in range(8):
        at = code == c
        assert tree.leaves[c] == pytest.approx(-frame.g0[at].sum() / (at.sum() + 1), abs=1e-7)
    total = np.square(frame.g0 + got.s).sum()
    assert total < 0.5 * np.square(frame.g0).sum()
