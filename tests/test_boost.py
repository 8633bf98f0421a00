import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slantree.plans import boost, directions, growth
from slantree.plans.boost import ObliqueBoostClassifier, ObliqueBoostRegressor, ObliqueModel
from slantree.plans.trees import route
from slantree.sources.tables import read_gain_log
from slantree.streaming.scoring import score_stream

#: Names that the fit uses itself; features may have them.
NAMES = ["f0", "F1x", "g0", "node", "score", "b_0", "number", "x"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    frame = pd.DataFrame(x, columns=["a", "b", "c"])
    frame["cat"] = rng.choice(["u", "v", "w"], 600)
    frame["y"] = (x[:, 0] + x[:, 1] > 0).astype(int)
    frame["k"] = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    frame["z"] = 2 * x[:, 0] - x[:, 2] + (frame["cat"] == "u") * 3
    frame["v"] = rng.uniform(size=600) < 0.3
    frame["w"] = 1.0
    frame.loc[:20, "a"] = np.nan
    return spark.createDataFrame(frame).persist()


def accuracy(out, y="y"):
    return out.agg(F.avg((F.col("prediction") == F.col(y)).cast("int"))).first()[0]


def test_classifier_round_trip(spark, rows, tmp_path):
    model = ObliqueBoostClassifier(featuresCols=["a", "b", "c"], rounds=3, maxDepth=2, learningRate=0.5, validationIndicatorCol="v").fit(rows)
    out = model.transform(rows)
    assert out.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda s, p: s + p) - 1) > 1e-9).count() == 0
    assert accuracy(out) > 0.8 and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    model.save_tables(spark, str(tmp_path / "m"))
    again = ObliqueModel.load_tables(spark, str(tmp_path / "m"))
    assert again.n_trees == 3 and out.select("probability").collect() == again.transform(rows).select("probability").collect()
    # The expression form and the Arrow form score alike.
    both = out.select(F.col("rawPrediction")[0].alias("p"), model.margins()[0].alias("q"))
    assert both.where(F.abs(F.col("p") - F.col("q")) > 1e-9).count() == 0
    assert model.split_records(spark).count() > 0
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 600


def test_scored_and_routed_counts_agree_whatever_the_names(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(NAMES)))
    frame = pd.DataFrame(x, columns=NAMES)
    frame["label"] = (x[:, 0] + x[:, 1] - x[:, 2] > 0).astype(int)
    df = spark.createDataFrame(frame)
    model = ObliqueBoostClassifier(featuresCols=NAMES, labelCol="label", rounds=2, maxDepth=2, learningRate=0.5, goss=False, subsample=1.0, minChildWeight=0.0).fit(df)
    nodes = model.trees[0].nodes
    at = route(nodes, x, np.array(model.means))
    g = 0.5 - frame["label"].to_numpy()
    for t, n in nodes.items():
        if not n.is_leaf:
            under = np.isin(at, [m for m in nodes if nodes[m].is_leaf and any((m + 1) >> s == t + 1 for s in range(1, 9))])
            left = np.isin(at, [m for m in nodes if nodes[m].is_leaf and any((m + 1) >> s == 2 * t + 2 for s in range(9))])
            score = [float(g[s].sum() ** 2 / (0.25 * s.sum() + 1)) for s in (left, under & ~left, under)]
            assert abs(2 * 0.5 * (score[0] + score[1] - score[2]) - n.gain) < 0.05 * n.gain + 0.5, (t, n.gain)
    assert accuracy(model.transform(df), "label") > 0.85


def test_huge_penalties_leave_a_root(rows):
    model = ObliqueBoostClassifier(featuresCols=["a", "b"], rounds=1, gamma=1000.0).fit(rows)
    assert len(model.trees[0].nodes) == 1
    model = ObliqueBoostClassifier(featuresCols=["a", "b"], rounds=1, maxDepth=1, regAlpha=1000.0).fit(rows)
    assert all(abs(v) < 1e-3 for n in model.trees[0].nodes.values() for v in n.leaf)


def test_leaf_budget_categories_and_unseen_values(spark, rows, tmp_path):
    model = ObliqueBoostRegressor(featuresCols=["a", "c", "cat"], labelCol="z", rounds=3, maxLeaves=5, learningRate=0.5, colsampleByNode=0.9).fit(rows)
    assert all(sum(n.is_leaf for n in t.nodes.values()) <= 5 for t in model.trees)
    assert all(sorted(t.ranks[2]) == [0.0, 1.0, 2.0, 3.0] for t in model.trees)
    error = model.transform(rows).agg(F.avg((F.col("prediction") - F.col("z")) ** 2), F.var_pop("z")).first()
    assert error[0] < 0.6 * error[1]
    odd = rows.limit(2).withColumn("cat", F.when(F.col("b") > 100, "u").otherwise("never seen")).union(rows.limit(2).withColumn("cat", F.lit(None).cast("string")))
    assert odd.count() == 4 and model.transform(odd).where("prediction is null or isnan(prediction)").count() == 0
    model.save_tables(spark, str(tmp_path / "m"))
    again = ObliqueModel.load_tables(spark, str(tmp_path / "m"))
    assert again.transform(odd).select("prediction").collect() == model.transform(odd).select("prediction").collect()


@pytest.mark.parametrize("loss", ["absolute_error", "huber"])
def test_losses_stop_by_their_own_loss(rows, loss):
    model = ObliqueBoostRegressor(featuresCols=["a", "c"], labelCol="z", rounds=2, maxDepth=2, learningRate=0.5, loss=loss, huberDelta=0.5, validationIndicatorCol="v", goss=False).fit(rows)
    mean = rows.where("v").select(F.abs(F.lit(model.init[0]) - F.col("z")).alias("e"))
    want = mean.agg(F.avg("e" if loss == "absolute_error" else F.expr("if(e <= 0.5, 0.5*e*e, 0.5*(e - 0.25))"))).first()[0]
    assert abs(model.losses[0] - want) < 1e-9 and len(model.losses) == 3


def test_patience_keeps_the_best_prefix(spark, rows):
    noise = rows.withColumn("y", F.when(F.col("v"), 1 - F.col("y")).otherwise(F.col("y")))
    model = ObliqueBoostClassifier(featuresCols=["a", "b"], rounds=6, maxDepth=2, learningRate=0.5, validationIndicatorCol="v", patience=2).fit(noise)
    assert model.n_trees == 0 and len(model.losses) == 3


def test_one_vs_rest_and_weights(spark, rows, tmp_path):
    model = ObliqueBoostClassifier(featuresCols=["a", "b"], labelCol="k", rounds=2, maxDepth=2, learningRate=0.5, multiStrategy="ovr").fit(rows)
    out = model.transform(rows)
    assert len(model.parts) == 3 and accuracy(out, "k") > 0.7
    model.save_tables(spark, str(tmp_path / "m"))
    again = ObliqueModel.load_tables(spark, str(tmp_path / "m")).transform(rows)
    assert out.select("probability").collect() == again.select("probability").collect()
    heavy = rows.withColumn("w", F.when(F.col("y") == 1, 0.0).otherwise(1.0))
    model = ObliqueBoostClassifier(featuresCols=["a", "b"], weightCol="w", rounds=10, maxDepth=2, learningRate=0.5, goss=False, subsample=1.0).fit(heavy)
    assert model.transform(rows).where("prediction = 1").count() == 0


def test_balanced_decision_uses_the_prior_to_a_power(spark):
    p = spark.createDataFrame([([0.8, 0.2],), ([0.95, 0.05],)], "p array<double>")
    assert [r[0] for r in p.select(boost.decided(F.col("p"), [0.9, 0.1], 0.5)).collect()] == [0, 0]
    assert [r[0] for r in p.select(boost.decided(F.col("p"), [0.9, 0.1], 1.0)).collect()] == [1, 0]


def test_bad_input_is_named(spark, rows):
    for bad, args in ((rows, {"featuresCols": ["nope"]}), (rows.limit(0), {"featuresCols": ["a"]}), (rows.withColumn("y", F.lit("text")), {"featuresCols": ["a"]}), (rows.withColumn("y", F.lit(0.5)), {"featuresCols": ["a"]})):
        with pytest.raises(ValueError):
            ObliqueBoostClassifier(rounds=1, **args).fit(bad)


def test_directions():
    rng = np.random.default_rng(0)
    sis, xg, active = np.arange(1.0, 9.0), np.array([1.0, -1] * 4), np.ones(8, bool)
    made = directions.blocks(sis, xg, active, rng, 10)
    assert len(made) == 10 and all(abs(np.linalg.norm(w) - 1) < 1e-9 for w in made)
    assert abs(made[1] @ made[2]) < 1e-9, "one block's directions are orthogonal"
    cache = directions.Cache()
    for w in (made[1], 2 * made[1], made[2]):
        cache.add(w)
    assert len(cache.kept) == 2
    params = {"inherited": 1.0, "pobs": True, "mutation_rate": 0.1, "mutation_strength": 0.5}
    tried = directions.pool(sis, xg, active, made[1], cache, 1, 32, params, rng)
    assert 20 < len(tried) <= 34 and all(np.count_nonzero(w) > 1 for w in tried)
    gram, g = np.diag([1.0, 4.0]), np.array([2.0, 2.0])
    assert np.allclose(directions.wls(gram, g, 0.0), directions.unit(np.array([-2.0, -0.5])))


def same_trees(a, b):
    assert len(a) == len(b)
    for s, t in zip(a, b):
        assert {n: (m.family, m.threshold, [float(v) for v in m.w]) for n, m in s.nodes.items()} == {n: (m.family, m.threshold, [float(v) for v in m.w]) for n, m in t.nodes.items()}
        assert all(np.allclose(m.leaf, t.nodes[n].leaf) for n, m in s.nodes.items())


def test_sums_added_by_spark_or_by_the_driver(spark, rows, monkeypatch):
    """The same trees whether sums meet in the driver or in tasks, and whether or not Spark picks the best cut."""
    est = ObliqueBoostClassifier(featuresCols=["a", "b", "c", "cat"], labelCol="k", rounds=2, maxLeaves=6, learningRate=0.5, minRows=5)
    local = est.fit(rows)
    monkeypatch.setattr(growth, "MOST_LOCAL", 0)
    spread = est.fit(rows)
    same_trees(local.trees, spread.trees)
    monkeypatch.setattr(growth, "MOST_COMPARED", 0)
    same_trees(local.trees, est.fit(rows).trees)


def test_best_first_does_not_depend_on_how_far_it_looks_ahead(rows, monkeypatch):
    est = ObliqueBoostRegressor(featuresCols=["a", "b", "c"], labelCol="z", rounds=1, maxLeaves=7, directions=0, goss=False, subsample=1.0)
    far = est.fit(rows)
    monkeypatch.setattr(growth, "AHEAD", 1)
    same_trees(far.trees, est.fit(rows).trees)
    gains = [n.gain for n in far.trees[0].nodes.values() if not n.is_leaf]
    assert len(gains) == 6


def test_siblings_by_subtraction_are_the_sums_of_their_rows(spark):
    """Every split's gain is that of the rows which the tree routes to it."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 4))
    frame = pd.DataFrame(x, columns=list("abcd"))
    frame["y"] = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0)
    model = ObliqueBoostRegressor(featuresCols=list("abcd"), rounds=1, maxLeaves=9, directions=0, goss=False, subsample=1.0, regLambda=0.0, smoothLeaves=False).fit(spark.createDataFrame(frame))
    nodes, e = model.trees[0].nodes, model.init[0] - frame["y"].to_numpy()
    for t, n in nodes.items():
        rows = route({u: m for u, m in nodes.items() if u < t or u == t}, x, np.array(model.means))
        at = np.isin(rows, [t, 2 * t + 1, 2 * t + 2])
        if n.is_leaf:
            assert n.leaf[0] == pytest.approx(-e[at].mean(), abs=1e-9)
        else:
            side = at & (rows == 2 * t + 1)
            want = 0.5 * (e[side].sum() ** 2 / side.sum() + e[at & ~side].sum() ** 2 / (at & ~side).sum() - e[at].sum() ** 2 / at.sum())
            assert n.gain == pytest.approx(want, rel=1e-6)


def test_one_side_sampling_in_a_fit_is_exact(spark, monkeypatch):
    """However small the sample: the rows of largest gradient, ties by hash, and so many of the others."""
    rng = np.random.default_rng(9)
    n = 5000
    for g in (np.round(rng.normal(size=(n, 1)), 1), np.full((n, 1), 0.5), rng.normal(size=(n, 2))):
        frame = pd.DataFrame({"x": [[float(v)] for v in rng.normal(size=n)], "y": 0.0, "w": 1.0, "valid": False, "number": np.arange(n) * 3, "score": [[*map(float, row), *[1.0] * len(row)] for row in g]})
        p = boost.PLAIN | {"goss": (0.2, 0.1), "sample_rows": 300}
        r = growth.Round([{"lo": -5.0, "hi": 5.0, "mean": 0.0, "active": True}], {}, g.shape[1], "given", p, 5)
        state = growth.coded_table(spark.createDataFrame(frame, "x array<double>, y double, w double, valid boolean, number long, score array<double>").repartition(3), r).persist()
        sample = growth.draw(state, r, n, 4)
        assert 200 < len(sample.number) < 400
        for most in (1 << 19, 200):
            monkeypatch.setattr(growth, "MOST_ORDERED", most)
            r.cut = growth.one_side_cut(state, r, n, sample, sample.graded(r)[0])
            used, factor = r.chosen(g, np.ones_like(g), np.arange(n) * 3)
            top = used & (factor == 1)
            size = np.abs(g).mean(1)
            assert top.sum() == 1000 and (used & ~top).sum() == 400 and np.allclose(factor[used & ~top], 8.0)
            assert size[top].min() >= size[~top].max()


def test_directions_are_remembered_over_rounds_and_numeric_only(rows, monkeypatch):
    held = []
    real = directions.Cache.add
    monkeypatch.setattr(directions.Cache, "add", lambda self, w: (held.append((id(self), np.array(w))), real(self, w))[1])
    model = ObliqueBoostClassifier(featuresCols=["a", "b", "c", "cat"], rounds=4, maxDepth=2, learningRate=0.5).fit(rows)
    committed = [np.array(n.w) for t in model.trees for n in t.nodes.values() if n.family == "oblique"]
    assert held and len({i for i, _ in held}) == 1 and all(w[3] == 0 for _, w in held)
    assert len(held) == sum(w[3] == 0 for w in committed)


def test_deep_nodes_are_sampled_by_themselves(spark, monkeypatch):
    """Oblique candidates at nodes of 64 rows and more, though the table's sample has few of theirs."""
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(20_000, 3))
    frame = pd.DataFrame(x, columns=list("abc"))
    frame["y"] = (np.sin(9 * (x[:, 0] + x[:, 1])) + np.sin(7 * (x[:, 1] - x[:, 2])) > 0).astype(int)
    seen = []
    real = growth.propose
    monkeypatch.setattr(growth, "propose", lambda r, tree, sample, t, *a: (seen.append((t, len(sample))), real(r, tree, sample, t, *a))[1])
    model = ObliqueBoostClassifier(featuresCols=list("abc"), rounds=1, maxLeaves=40, minRows=40, sampleRows=500, nodeSample=300, goss=False, subsample=1.0).fit(spark.createDataFrame(frame))
    deep = [n for n in model.trees[0].nodes.values() if n.id > 14 and not n.is_leaf]
    assert len(deep) > 5 and any(n.family == "oblique" for n in deep)
    assert min(size for t, size in seen if t > 6) >= 64 and max(size for t, size in seen if t) < 900


@pytest.mark.parametrize("name", ["covariance", "wls"])
def test_directions_from_all_rows(spark, name):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 4))
    frame = pd.DataFrame(x, columns=list("abcd"))
    frame["y"] = x @ np.array([1.0, -2.0, 0.5, 0.0]) + 0.1 * rng.normal(size=3000)
    model = ObliqueBoostRegressor(featuresCols=list("abcd"), rounds=1, maxLeaves=4, directions=0, exactDirections=[name], goss=False, subsample=1.0).fit(spark.createDataFrame(frame))
    root = model.trees[0].nodes[0]
    centre, width = x.mean(0), x.max(0) - x.min(0)
    z, e = (x - centre) / width, model.init[0] - frame["y"].to_numpy()
    want = -z.T @ e if name == "covariance" else np.linalg.solve(z.T @ z + np.eye(4), -z.T @ e)
    assert root.family == name
    assert np.allclose(np.array(root.w) * width / np.linalg.norm(np.array(root.w) * width), want / np.linalg.norm(want), atol=1e-6)
    left = x @ np.array(root.w) < root.threshold
    assert root.gain == pytest.approx(0.5 * (e[left].sum() ** 2 / (left.sum() + 1) + e[~left].sum() ** 2 / ((~left).sum() + 1) - e.sum() ** 2 / 3001), rel=1e-6)


def test_gain_log(spark, rows, tmp_path):
    est = ObliqueBoostClassifier(featuresCols=["a", "b", "c"], rounds=2, maxLeaves=5, learningRate=0.5, gainLogPath=str(tmp_path / "log"))
    model = est.fit(rows)
    log = read_gain_log(spark, str(tmp_path / "log")).toPandas()
    assert set(log.tree_id) == {0, 1} and {f for g in log.gains for f in g} >= {"axis", "block"}
    for t, tree in enumerate(model.trees):
        for n in tree.nodes.values():
            if not n.is_leaf:
                own = log[(log.tree_id == t) & (log.node_seq == n.id)].gains.iloc[0]
                assert n.family != "axis" or max(own["axis"]) == pytest.approx(n.gain)
    plain = ObliqueBoostClassifier(featuresCols=["a", "b", "c"], rounds=2, maxLeaves=5, learningRate=0.5).fit(rows)
    same_trees(model.trees, plain.trees)


def test_metrics_of_each_round(spark, rows):
    model = ObliqueBoostClassifier(featuresCols=["a", "b"], rounds=3, maxDepth=2, learningRate=0.5, validationIndicatorCol="v").fit(rows)
    got = model.metrics_table(spark).toPandas()
    assert got["round"].tolist() == [0, 1, 2, 3] and got.loss.tolist() == model.losses
    assert got.accuracy.iloc[-1] == pytest.approx(accuracy(model.transform(rows.where("v"))))
    model = ObliqueBoostRegressor(featuresCols=["a"], labelCol="z", rounds=1, maxDepth=1, validationIndicatorCol="v").fit(rows)
    assert model.metrics_table(spark).where("accuracy is null").count() == 2


def test_scores_are_added_up_and_written(spark, rows, monkeypatch):
    est = ObliqueBoostRegressor(featuresCols=["a", "c"], labelCol="z", rounds=5, maxDepth=2, learningRate=0.3, directions=4)
    want = est.fit(rows)
    monkeypatch.setattr(boost, "ADDED_EVERY", 2)
    same_trees(want.trees, est.fit(rows).trees)


def test_a_fitted_pipeline_is_saved_and_loaded(spark, rows, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import SQLTransformer

    for est in (ObliqueBoostClassifier(featuresCols=["a", "half", "cat"], rounds=2, maxDepth=2, learningRate=0.5), ObliqueBoostClassifier(featuresCols=["a", "half"], labelCol="k", rounds=2, maxDepth=2, multiStrategy="ovr"), ObliqueBoostRegressor(featuresCols=["a", "half"], labelCol="z", rounds=2, maxDepth=2)):
        fitted = Pipeline(stages=[SQLTransformer(statement="select *, b / 2 as half from __THIS__"), est]).fit(rows)
        path = str(tmp_path / type(est).__name__) + est.getOrDefault("multiStrategy")
        fitted.write().overwrite().save(path)
        again = PipelineModel.load(path)
        assert fitted.transform(rows).select("prediction").collect() == again.transform(rows).select("prediction").collect()
        assert again.stages[1].uid == fitted.stages[1].uid and again.stages[1].getOrDefault("maxDepth") == 2
        est.save(path + "-estimator")
        assert type(est).load(path + "-estimator").getOrDefault("rounds") == 2


def test_what_the_first_trees_are_worth(spark, rows):
    held = rows.where("v")
    model = ObliqueBoostClassifier(featuresCols=["a", "b", "cat"], rounds=3, maxDepth=2, learningRate=0.5, validationIndicatorCol="v").fit(rows)
    got = model.staged(held).orderBy("trees").toPandas()
    assert got.trees.tolist() == [0, 1, 2, 3] and np.allclose(got.loss, model.losses) and np.allclose(got.accuracy, [m["accuracy"] for m in model.metrics])
    model = ObliqueBoostRegressor(featuresCols=["a", "c"], labelCol="z", rounds=2, maxDepth=2, loss="huber", validationIndicatorCol="v").fit(rows)
    got = model.staged(held).orderBy("trees").toPandas()
    assert np.allclose(got.loss, model.losses) and got.accuracy.isna().all()
    assert model.staged(held.limit(0)).count() == 0
