"""Studies and experiments against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantree.functions import analysis, studies
from slantree.operators import prepare
from slantree.plans import directions, runs
from slantree.plans.boost import ObliqueBoostClassifier
from slantree.sources.tables import read_gain_log


def test_largest_of_draws_from_several_families():
    rng = np.random.default_rng(0)
    draws = {"a": rng.normal(size=5), "b": rng.normal(size=4) + 0.3, "c": np.array([0.1, 0.1, 2.0])}
    for spent in ({"a": 2, "b": 1, "c": 0}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 0, "c": 2}):
        lists = [draws[f] for f, n in spent.items() for _ in range(n)]
        want = np.mean([max(x) for x in itertools.product(*lists)])
        assert studies.union_best(draws, spent) == pytest.approx(want)
    assert studies.union_best(draws, {"a": 0}) is None


def test_greedy_budget_against_brute_force(spark):
    rng = np.random.default_rng(1)
    nodes = {n: {f: rng.gamma(2, 1 + (f == "b") * (n % 3), size=rng.integers(2, 7)) for f in "abc"} for n in range(25)}
    nodes[30] = {"a": np.array([-1.0, -2.0, -3.0])}
    rows = [(n, f, float(v)) for n, fams in nodes.items() for f, vs in fams.items() for v in vs]
    spent, mean = studies.greedy_budget(spark.createDataFrame(rows, "node int, family string, gain double"), 32)

    def value(trial):
        found = []
        for fams in nodes.values():
            top = max(v.max() for v in fams.values())
            best = studies.union_best({f: v / top for f, v in fams.items() if len(v) >= 3}, trial) if top > 0 else None
            if best is not None:
                found.append(best)
        return np.mean(found) if found else 0.0

    want, at = {f: 0 for f in "abc"}, 0.0
    for _ in range(32):
        f = max("abc", key=lambda f: (value({**want, f: want[f] + 1}), -ord(f)))
        if value({**want, f: want[f] + 1}) <= at:
            break
        want[f] += 1
        at = value(want)
    assert spent == want and mean == pytest.approx(at)


def test_coordinate_ascent_never_falls_and_finds_the_solution():
    rng = np.random.default_rng(27)
    x = rng.normal(size=(50, 40, 4))
    gram, xg = np.einsum("nri,nrj->nij", x, x) + np.eye(4), rng.normal(size=(50, 4))
    start = rng.normal(size=(50, 4))
    start[3] = 0
    last = directions.ratio(gram, xg, directions.ascended(gram, xg, start, 0))
    for passes in (1, 2, 3, 40):
        now = directions.ratio(gram, xg, directions.ascended(gram, xg, start, passes))
        assert (now >= last - 1e-12).all()
        last = now
    best = np.einsum("ni,ni->n", xg, np.linalg.solve(gram, xg[..., None])[..., 0])
    assert np.allclose(last, best, rtol=1e-6), "the maximum of J is that of the solution of the normal equations"
    w = directions.ascended(gram, xg, start, 40)
    solved = np.array([directions.wls(a, g, 0.0) for a, g in zip(gram, xg)])
    assert np.allclose(np.abs(np.einsum("ni,ni->n", w, solved)), 1, atol=1e-6)


def test_descent_of_a_null_gradient(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0, 0.0, 1.0), ("p", 2.0, 1.0, 0.0, 1.0), ("q", 1.0, 1.0, 1.0, 1.0)], "node string, a double, b double, g double, h double")
    got = {r["node"]: r for r in studies.descent(studies.grams(df, ["a", "b"], "g", "h")).collect()}
    assert got["p"]["j_before"] == got["p"]["j_after"] == 0 and got["q"]["j_after"] >= got["q"]["j_before"] > 0


def test_cones(spark):
    parents = spark.createDataFrame([(1, [3.0, 4.0, 0.0]), (2, [0.0, 0.0, 1.0])], "node int, w array<double>")
    rows = studies.cone_directions(parents, [[1.0, 2.0, 2.0], [0.0, 0.0, 5.0]]).collect()
    assert len(rows) == 11, "an offset along its parent has no orthogonal direction"
    for r in rows:
        p, w = np.array([0.6, 0.8, 0.0] if r["node"] == 1 else [0.0, 0.0, 1.0]), np.array(r["w"])
        assert np.linalg.norm(w) == pytest.approx(1)
        assert r["cone"] != "orth" or abs(w @ p) < 1e-9
        assert r["cone"] != "near" or w @ p > 0.95


def test_pairs_across_trees_grow_with_what_is_asked(spark):
    rng = np.random.default_rng(4)
    rows = [(t, n, rng.normal(size=3).tolist()) for t in range(300) for n in range(7)]
    records = spark.createDataFrame(rows, "tree_id int, node_id int, w array<double>")
    few, many = (studies.cross_tree_pairs(records, n) for n in (100, 10_000))
    assert 60 < few.count() < 160 and 800 < many.count() < 1300
    assert many.where("tree_a = tree_b or deg < 0 or deg > 90").count() == 0
    assert few.join(many, ["tree_a", "node_a", "tree_b", "node_b"]).count() == few.count()
    assert studies.cross_tree_pairs(records.limit(0), 5).count() == 0


def test_win_rates_from_a_gain_log(spark, tmp_path):
    """Who wins each logged node: the family of its largest candidate gain."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    df = spark.createDataFrame([(*map(float, r), int(r[0] + r[1] > 0)) for r in x], "a double, b double, c double, y int")
    ObliqueBoostClassifier(featuresCols=["a", "b", "c"], rounds=2, maxLeaves=6, gainLogPath=str(tmp_path / "log")).fit(df)
    log = read_gain_log(spark, str(tmp_path / "log"))
    flat = log.select("tree_id", "node_seq", "depth", F.explode("gains").alias("family", "gs")).select(F.struct("tree_id", "node_seq").cast("string").alias("tree_id"), "depth", "family", F.explode("gs").alias("gain"))
    got = {(r["bucket"], r["family"]): r["share"] for r in analysis.win_by_bucket(flat).collect()}
    wins = {}
    for r in log.collect():
        top = min(r["gains"], key=lambda f: (-max(r["gains"][f]), f))
        wins.setdefault(int(r["depth"] > 2), []).append(top)
    assert got == {(b, f): pytest.approx(own.count(f) / len(own)) for b, own in wins.items() for f in set(own)}
    curves = studies.marginal_curves(flat.withColumnRenamed("tree_id", "node"), [1, 4])
    assert curves.where("value > 1.0000001").count() == 0 and curves.count() > 2


def test_a_failing_cell_is_a_row(spark):
    rng = np.random.default_rng(5)
    good = spark.createDataFrame([(k, float(v), int(v > 0)) for k, v in enumerate(rng.normal(size=400))], "id long, a double, y int").persist()

    def unreadable():
        raise FileNotFoundError("no such table")

    models = {"boost": ObliqueBoostClassifier(featuresCols=["a"], rounds=2, maxDepth=1, learningRate=0.5), "wrong": ObliqueBoostClassifier(featuresCols=["absent"], rounds=1)}
    got = runs.run_cells({"good": good, "bad": unreadable}, models, "id", reps=2).collect()
    assert len(got) == 8
    by = {(r["dataset"], r["rep"], r["model"]): r for r in got}
    assert all(by["good", k, "boost"]["value"] > 0.95 and by["good", k, "boost"]["error"] is None for k in (0, 1))
    assert all(by["good", k, "wrong"]["value"] is None and "absent" in by["good", k, "wrong"]["error"] for k in (0, 1))
    assert all(r["error"] == "FileNotFoundError: no such table" for r in got if r["dataset"] == "bad")


def test_sweeps_by_real_fits(spark):
    """Rotation, missing values and cardinality, each with a model behind it."""
    rng = np.random.default_rng(6)
    base = spark.createDataFrame([(k, *map(float, rng.normal(size=2))) for k in range(500)], "id long, a double, b double").withColumn("y", (F.col("a") > 0).cast("int"))
    turned = {f"rotation {s}": prepare.rotate(base, ["a", "b"], prepare.blended_rotation([[0.8, -0.6], [0.6, 0.8]], s)).drop("a", "b").withColumnsRenamed({"r0": "a", "r1": "b"}) for s in (0.0, 1.0)}
    holes = {f"missing {s}": prepare.inject_missing(base, ["a"], "id", s) for s in (0.0, 0.5)}
    cards = {"cards": prepare.hashed_categories(base, "id", [3]).withColumn("c3", F.col("c3").cast("string"))}
    small = {"rounds": 2, "maxDepth": 2, "learningRate": 0.5, "goss": False}
    got = runs.run_cells(turned | holes, {"m": ObliqueBoostClassifier(featuresCols=["a", "b"], **small)}, "id").union(runs.run_cells(cards, {"m": ObliqueBoostClassifier(featuresCols=["a", "c3"], **small)}, "id"))
    value = {r["dataset"]: r["value"] for r in got.collect()}
    assert len(value) == 5 and None not in value.values()
    assert value["missing 0.0"] > value["missing 0.5"] > 0.6 and value["rotation 1.0"] > 0.85 and value["cards"] > 0.9


def test_successive_halving(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 2))
    df = spark.createDataFrame([(k, float(a), float(b), int(a * b > 0)) for k, (a, b) in enumerate(x)], "id long, a double, b double, y int").persist()
    grid = [{"rounds": 1, "maxDepth": 1}, {"rounds": 4, "maxDepth": 3}, {"rounds": 1, "maxDepth": 1, "gamma": 1e9}, {"rounds": 1, "maxDepth": 1, "regLambda": 1e6}]
    best, found = runs.successive_halving(df, ObliqueBoostClassifier(featuresCols=["a", "b"], learningRate=0.5, goss=False, directions=4), grid, "id")
    assert best == grid[1]
    rungs = [sorted(r["params"] for r in found.where(F.col("rung") == k).collect()) for k in range(3)]
    assert len(rungs[0]) == 4 and len(rungs[1]) == 2 and rungs[2] == [1]
    assert [r["share"] for r in found.select("rung", "share").distinct().orderBy("rung").collect()] == [0.125, 0.25, 0.5]
