"""Boosting: the pyspark.ml estimators, and the fitted model.

A round is one tree (`growth.grow`), preceded by a job for the validation loss
and the categories' gradient sums where there are any, and by one for the cut of
one-side sampling.  Scores are not rewritten every round: tasks add the trees of
the last rounds, and every ADDED_EVERY rounds the table takes them in.  Every
DURABLE_EVERY rounds it is written to the shared folder, which cuts its lineage,
and the copy before is deleted.

The driver sees a bounded sample, one row per node and feature, and nothing that
grows with the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, NumericType

from slantree.operators import gradients, prepare
from slantree.plans import directions
from slantree.plans.growth import STATE, Log, Round, coded_table, draw, grow, loss_of, matrix, surveyed
from slantree.plans.trees import Node, Tree, goes_left, left_of, ranked, route, tree_value, values  # noqa: F401
from slantree.sources.folders import removed, written
from slantree.sources.tables import GAIN_LOG, write_gain_log

ADDED_EVERY, DURABLE_EVERY = 5, 50
#: Categories up to which a dictionary is broadcast, and classes of a fit.
MOST_SENT, MOST_CLASSES = 100_000, 10_000


def added(state: DataFrame, trees: list[tuple[Tree, float, np.ndarray]], k: int, d: int) -> DataFrame:
    """The training table with the values of trees (and their rates and means) added to the scores."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, x = matrix(batch.column("score"), k), matrix(batch.column("x"), d)
            for tree, rate, means in trees:
                score = score + rate * values(tree, x, means, k)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(score) * k + 1, k), pa.int32()), pa.array(score.ravel()))
            yield pa.record_batch([lists if c == "score" else batch.column(c) for c in names], names)

    return state.mapInArrow(work, STATE)


def encoded(df: DataFrame, col: str, values_: DataFrame, card: int, into: str) -> DataFrame:
    """Category ids by a left join: null and unseen values get `card`."""
    sent = F.broadcast(values_) if card <= MOST_SENT else values_
    return prepare.encode(df, col, sent, into, card)


def fit_tree(df: DataFrame, features: list[str], g_cols: list[str], h_cols: list[str], params: dict | None = None, seed: int = 42) -> tuple[Tree, np.ndarray]:
    """One tree on given gradients: the hook for objectives of one's own.  Returns it with the means that stand for missing values."""
    k = len(g_cols)
    p = PLAIN | (params or {}) | {"seed": seed}
    stats = statistics(df, features)
    x, given = F.array(*[number_or_nan(c) for c in features]), F.array(*[F.col(f"`{c}`").cast("double") for c in [*g_cols, *h_cols]])
    rows = df.select(x.alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(False).alias("valid"), F.monotonically_increasing_id().alias("number"), given.alias("score"))
    r = Round(stats, {}, k, "given", p, 0)
    state, path = written(coded_table(rows, r))
    state = state.persist()
    n, r.parts = state.count(), state.rdd.getNumPartitions()
    tree = grow(state, r, n, draw(state, r, n, seed), np.random.default_rng(seed), directions.Cache(), {})
    state.unpersist()
    removed(df.sparkSession, path)
    return tree, r.means


def number_or_nan(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))


def statistics(df: DataFrame, cols: list[str]) -> list[dict]:
    stats = [r.asDict() for r in prepare.column_stats(df, cols).orderBy("f").collect()] if cols else []
    return [s | {c: s[c] or 0.0 for c in ("lo", "hi", "mean")} for s in stats]


#: Parameters of a round in their plain values.
PLAIN = {"bins": 255, "lam": 1.0, "alpha": 0.0, "gamma": 0.0, "leaves": 64, "deepest": 12, "min_rows": 10, "min_weight": 1.0, "directions": 64, "colsample": 1.0, "subsample": 1.0, "goss": None, "delta": 1.0, "inherited": 1.0, "mutation_rate": 0.1, "mutation_strength": 0.5, "pobs": False, "seed": 42, "sample_rows": 16_384, "node_sample": 2048, "exact": (), "smooth": True}


class _Shared(Params):
    featuresCols = Param(Params._dummy(), "featuresCols", "feature columns; text columns count as categories", TypeConverters.toListString)
    catCols = Param(Params._dummy(), "catCols", "feature columns that are categories besides the text ones", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label column; classes are 0..K-1", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weights, or empty", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "trees at most", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "2 ** maxDepth leaves; the depth is at most min(2 maxDepth, 22)", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree instead of 2 ** maxDepth; 0 for none", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2", TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "L1 on gradient sums", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "least gain", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian of a side, over classes", TypeConverters.toFloat)
    minRows = Param(Params._dummy(), "minRows", "least rows of a side", TypeConverters.toInt)
    maxBin = Param(Params._dummy(), "maxBin", "bins, the missing one included (2 to 255)", TypeConverters.toInt)
    directions = Param(Params._dummy(), "directions", "oblique candidates per node; 0 for axis splits only", TypeConverters.toInt)
    inheritedRatio = Param(Params._dummy(), "inheritedRatio", "share of the candidates made from the parent's direction", TypeConverters.toFloat)
    mutationRate = Param(Params._dummy(), "mutationRate", "how far inherited weights move", TypeConverters.toFloat)
    mutationStrength = Param(Params._dummy(), "mutationStrength", "weight of a feature added to an inherited direction", TypeConverters.toFloat)
    pobs = Param(Params._dummy(), "pobs", "eight orthogonal blocks among the inherited candidates", TypeConverters.toBoolean)
    sampleRows = Param(Params._dummy(), "sampleRows", "rows of the sample that proposes oblique splits of the first nodes", TypeConverters.toInt)
    nodeSample = Param(Params._dummy(), "nodeSample", "rows of a node that propose its oblique splits, where that sample has too few of it", TypeConverters.toInt)
    exactDirections = Param(Params._dummy(), "exactDirections", "directions solved from sums over all rows of a node: covariance, wls", TypeConverters.toListString)
    smoothLeaves = Param(Params._dummy(), "smoothLeaves", "draw leaf values towards the parent's", TypeConverters.toBoolean)
    gainLogPath = Param(Params._dummy(), "gainLogPath", "folder for the gains of all candidates, or empty", TypeConverters.toString)
    colsampleByNode = Param(Params._dummy(), "colsampleByNode", "share of features a node may use", TypeConverters.toFloat)
    goss = Param(Params._dummy(), "goss", "one-side sampling by gradient", TypeConverters.toBoolean)
    gossTopRate = Param(Params._dummy(), "gossTopRate", "share of rows of largest gradient, all kept", TypeConverters.toFloat)
    gossOtherRate = Param(Params._dummy(), "gossOtherRate", "share kept of the others", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of rows per round, without one-side sampling", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    balanced = Param(Params._dummy(), "balanced", "divide probabilities by class priors to the power priorAlpha before deciding", TypeConverters.toBoolean)
    priorAlpha = Param(Params._dummy(), "priorAlpha", "that power", TypeConverters.toFloat)
    multiStrategy = Param(Params._dummy(), "multiStrategy", "shared, or ovr: one binary model per class from three classes on", TypeConverters.toString)
    loss = Param(Params._dummy(), "loss", "squared_error (l2), absolute_error (l1) or huber", TypeConverters.toString)
    huberDelta = Param(Params._dummy(), "huberDelta", "where huber turns linear", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "rounds without a better validation loss before stopping; 0 for none", TypeConverters.toInt)
    validationIndicatorCol = Param(Params._dummy(), "validationIndicatorCol", "boolean column of validation rows, or empty", TypeConverters.toString)
    verbose = Param(Params._dummy(), "verbose", "print the validation loss of each round", TypeConverters.toBoolean)

    def __init__(self, **values_):
        super().__init__()
        self._setDefault(catCols=[], weightCol="", labelCol="y", rounds=1000, maxDepth=6, maxLeaves=0, learningRate=0.03, regLambda=1.0, regAlpha=0.0, gamma=0.0, minChildWeight=1.0, minRows=10, maxBin=255)
        self._setDefault(directions=64, inheritedRatio=1.0, mutationRate=0.1, mutationStrength=0.5, pobs=False, colsampleByNode=1.0, goss=True, gossTopRate=0.2, gossOtherRate=0.1, subsample=0.8, seed=42)
        self._setDefault(balanced=False, priorAlpha=0.5, multiStrategy="shared", loss="squared_error", huberDelta=1.0, patience=50, validationIndicatorCol="", verbose=False, sampleRows=16_384, nodeSample=2048, exactDirections=[], smoothLeaves=True, gainLogPath="")
        self._set(**values_)


class _ObliqueEstimator(_Shared, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    classification = True

    def _round_params(self) -> dict:
        get = self.getOrDefault
        depth = get("maxDepth")
        return {
            "bins": min(255, max(2, get("maxBin"))),
            "lam": get("regLambda"),
            "alpha": get("regAlpha"),
            "gamma": get("gamma"),
            "leaves": get("maxLeaves") or 2**depth,
            "deepest": min(2 * depth, 22),
            "min_rows": get("minRows"),
            "min_weight": get("minChildWeight"),
            "directions": get("directions"),
            "colsample": get("colsampleByNode"),
            "subsample": 1.0 if get("goss") else get("subsample"),
            "goss": (get("gossTopRate"), get("gossOtherRate")) if get("goss") else None,
            "delta": get("huberDelta"),
            "inherited": get("inheritedRatio"),
            "mutation_rate": get("mutationRate"),
            "mutation_strength": get("mutationStrength"),
            "pobs": get("pobs"),
            "sample_rows": get("sampleRows"),
            "node_sample": get("nodeSample"),
            "exact": tuple(get("exactDirections")),
            "smooth": get("smoothLeaves"),
            "seed": get("seed"),
        }

    def _checked(self, df: DataFrame) -> tuple[DataFrame, list[str], list[str], int]:
        """Rows with a label, numeric and categorical features, and the number of classes (1 for regression)."""
        get = self.getOrDefault
        label, wanted = get("labelCol"), get("featuresCols")
        absent = [c for c in [*wanted, label, *filter(None, (get("weightCol"), get("validationIndicatorCol")))] if c not in df.columns]
        if absent:
            raise ValueError(f"missing columns: {absent}")
        if not isinstance(df.schema[label].dataType, NumericType):
            raise ValueError(f"the label {label} must be a number")
        if not self.classification and get("loss") not in ("squared_error", "l2", "absolute_error", "l1", "huber"):
            raise ValueError(f"unknown loss {get('loss')}")
        cats = [c for c in wanted if c in get("catCols") or not isinstance(df.schema[c].dataType, NumericType)]
        y = F.col(f"`{label}`").cast("double")
        rows = df.where(y.isNotNull() & ~F.isnan(y))
        n, least, most, whole = rows.agg(F.count("*"), F.min(y), F.max(y), F.min((y == F.floor(y)).cast("int"))).first()
        if not n:
            raise ValueError("no row has a label")
        if self.classification and (least < 0 or not whole or most > MOST_CLASSES):
            raise ValueError(f"classes must be numbered 0..K-1, with K up to {MOST_CLASSES + 1}")
        if set(get("exactDirections")) - {"covariance", "wls"}:
            raise ValueError("exactDirections may hold covariance and wls")
        return rows, [c for c in wanted if c not in cats], cats, int(most) + 1 if self.classification else 1

    def _fit(self, df: DataFrame) -> ObliqueModel:
        get = self.getOrDefault
        df, numeric, cats, k = self._checked(df)
        label, check, weight = get("labelCol"), get("validationIndicatorCol"), get("weightCol")
        if self.classification and k > 2 and get("multiStrategy") == "ovr":
            own = [self.copy()._set(multiStrategy="shared", seed=get("seed") + c) for c in range(k)]
            parts = [e._fit(df.withColumn(label, (F.col(f"`{label}`") == c).cast("int"))) for c, e in enumerate(own)]
            model = ObliqueModel(parts=parts, prior=self._prior(df, label, check, k))
            return self._copyValues(model)
        train = df.where(~F.coalesce(F.col(f"`{check}`"), F.lit(False))) if check else df
        stats = statistics(train, numeric)
        dictionaries = []
        columns = df.select(
            *[number_or_nan(c).alias(f"x{j}") for j, c in enumerate(numeric)],
            *[F.col(f"`{c}`").cast("string").alias(f"c{j}") for j, c in enumerate(cats)],
            F.col(f"`{label}`").cast("double").alias("y"),
            (F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("w"),
            (F.coalesce(F.col(f"`{check}`"), F.lit(False)) if check else F.lit(False)).alias("valid"),
        )
        for j in range(len(cats)):
            known = prepare.dictionary(columns.where("not valid"), f"c{j}").persist()
            card = known.count()
            dictionaries.append({r["value"]: r["id"] for r in known.collect()} if card <= MOST_SENT else None)
            if dictionaries[-1] is None:
                raise ValueError(f"{cats[j]} has {card} categories; the model holds {MOST_SENT} at most")
            columns = encoded(columns, f"c{j}", known, card, f"i{j}")
            stats.append({"lo": 0.0, "hi": float(card), "mean": card / 2, "active": card > 0})
        sizes = {len(numeric) + j: len(own) for j, own in enumerate(dictionaries)}
        prior = self._prior(train, label, "", k) if self.classification else [1.0]
        if self.classification:
            lp = [math.log(v + 1e-8) for v in prior]
            init = [v - sum(lp) / k for v in lp]
        else:
            init = [gradients.initial_value(columns.where("not valid"), get("loss"), "y", "w" if weight else None)]
        x = F.array(*[F.col(f"x{j}") for j in range(len(numeric))], *[F.col(f"i{j}").cast("double") for j in range(len(cats))])
        rows = columns.select(x.alias("x"), "y", "w", "valid", F.monotonically_increasing_id().alias("number"), F.array(*[F.lit(float(v)) for v in init]).alias("score"))
        p, rng = self._round_params(), np.random.default_rng(get("seed"))
        kind = "softmax" if self.classification else get("loss")
        state, path = written(coded_table(rows, Round(stats, sizes, k, kind, p, 0)))
        state = state.persist()
        n, parts = state.where("not valid").count(), state.rdd.getNumPartitions()
        spark, rate, cache, log = df.sparkSession, get("learningRate"), directions.Cache(), Log() if get("gainLogPath") else None
        trees: list[Tree] = []
        pending: list[tuple[Tree, float, np.ndarray]] = []
        best, best_at, losses, metrics, sample = math.inf, 0, [], [], None
        for t in range(get("rounds") + 1):
            r = Round(stats, sizes, k, kind, p, get("seed") * 1009 + t, pending, parts)
            if t == get("rounds") and not check:
                break
            by_id, seen = surveyed(state, r) if check or sizes else ({}, None)
            if seen is not None:  # what the t trees so far are worth on the validation rows
                losses.append(seen["loss"])
                metrics.append({"round": t, **seen})
                if get("verbose"):
                    print(f"round {t}: validation loss {seen['loss']:.6f}" + (f", accuracy {seen['accuracy']:.4f}" if self.classification else ""))
                if seen["loss"] < best:
                    best, best_at = seen["loss"], t
                elif get("patience") and t - best_at >= get("patience"):
                    trees = trees[:best_at]
                    break
            if t == get("rounds"):
                break
            if t % DURABLE_EVERY == 0:
                sample = draw(state, r, n, get("seed") * 1009 + t)
            tree = grow(state, r, n, sample, rng, cache, by_id, log)
            means = r.scales(tree)[0]
            trees.append(tree)
            pending = [*pending, (tree, rate, means)]
            sample.score = sample.score + rate * values(tree, sample.x, means, k)
            if (t + 1) % ADDED_EVERY == 0:
                new, old = added(state, pending, k, len(stats)), state
                pending = []
                if (t + 1) % DURABLE_EVERY == 0:
                    new, again = written(new)
                    state = new.persist()
                    state.count()
                    removed(spark, path)
                    path = again
                else:
                    state = new.persist()
                    state.count()
                old.unpersist()
        state.unpersist()
        removed(spark, path)
        if log is not None:
            rows = [(i - get("seed") * 1009, node, depth, ns, family, gain) for i, node, depth, ns, family, gain in log.rows]
            write_gain_log(spark.createDataFrame(rows, GAIN_LOG), get("gainLogPath"))
        model = ObliqueModel(trees, init, prior, [s["mean"] for s in stats], self.classification, numeric, cats, dictionaries, losses, metrics=metrics)
        return self._copyValues(model)

    @staticmethod
    def _prior(df: DataFrame, label: str, check: str, k: int) -> list[float]:
        rows = df.where(~F.coalesce(F.col(f"`{check}`"), F.lit(False))) if check else df
        found = {int(r["k"]): float(r["prior"]) for r in gradients.class_priors(rows, label).collect()}
        return [found.get(c, 0.0) for c in range(k)]


class ObliqueBoostClassifier(_ObliqueEstimator):
    """Boosted trees with axis and oblique splits; adds rawPrediction, probability and prediction."""


class ObliqueBoostRegressor(_ObliqueEstimator):
    """Squared, absolute or Huber loss; adds prediction."""

    classification = False


class ObliqueModel(_Shared, Model, MLWritable, MLReadable):
    """A fitted model; scoring is row-local, so the same model scores tables and streams."""

    def __init__(self, trees=None, init=None, prior=None, means=None, classification: bool = True, numeric=None, cats=None, dictionaries=None, losses=None, parts=None, metrics=None):
        super().__init__()
        self.trees, self.init, self.prior, self.means, self.classification = trees or [], init or [], prior or [], means or [], classification
        self.numeric, self.cats, self.dictionaries, self.losses, self.parts = numeric or [], cats or [], dictionaries or [], losses or [], parts or []
        self.metrics = metrics or []  # per round: round, loss, accuracy (None for regression)

    @property
    def n_trees(self) -> int:
        return sum(p.n_trees for p in self.parts) if self.parts else len(self.trees)

    def margin(self, df: DataFrame) -> Column:
        """The scores of each row as an array, summed over all trees in Arrow batches of a broadcast model."""
        if self.parts:
            return F.array(*[m[1] - m[0] for m in (p.margin(df) for p in self.parts)])
        k, d, rate = len(self.init), len(self.means), self.getOrDefault("learningRate")
        sent = df.sparkSession.sparkContext.broadcast((self.trees, np.array(self.init, float), np.array(self.means, float), self.dictionaries))

        def scored(x: np.ndarray, names: list[np.ndarray]) -> pa.Array:
            trees, init, means, dictionaries = sent.value
            ids = [np.array([own.get(v, len(own)) for v in column], float) for own, column in zip(dictionaries, names)]
            x = np.concatenate([x, *(i[:, None] for i in ids)], 1) if ids else x
            total = np.tile(init, (len(x), 1))
            for tree in trees:
                centre = means.copy()
                for f, ranks in tree.ranks.items():
                    centre[f] = (len(ranks) - 1) / 2
                total += rate * values(tree, x, centre, k)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k), pa.int32()), pa.array(total.ravel()))

        numeric, n_cats = d - len(self.cats), len(self.cats)

        @F.arrow_udf(ArrayType(DoubleType()))
        def margins(x: pa.Array, names: pa.Array) -> pa.Array:
            flat = names.flatten().to_pylist()
            return scored(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), numeric), [flat[j::n_cats] for j in range(n_cats)])

        return margins(*self._inputs())

    def _inputs(self) -> tuple[Column, Column]:
        """Numeric features and category names of a row, as arrays."""
        x = F.array(*[number_or_nan(c) for c in self.numeric]) if self.numeric else F.expr("cast(array() as array<double>)")
        return x, F.array(*[F.col(f"`{c}`").cast("string") for c in self.cats]) if self.cats else F.expr("cast(array() as array<string>)")

    def staged(self, df: DataFrame) -> DataFrame:
        """trees, loss, accuracy (null for regression): what the first 0, 1, .. trees are worth on rows with a label.

        Tasks go through the trees once and add a number a tree, so no row is shuffled.
        """
        if self.parts:
            raise ValueError("one-vs-rest models have no common rounds")
        k, d, rate, n_cats = len(self.init), len(self.means), self.getOrDefault("learningRate"), len(self.cats)
        kind, delta = "softmax" if self.classification else self.getOrDefault("loss"), self.getOrDefault("huberDelta")
        sent = df.sparkSession.sparkContext.broadcast((self.trees, np.array(self.init, float), np.array(self.means, float), self.dictionaries))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, init, means, dictionaries = sent.value
            sums = np.zeros((len(trees) + 1, 3))
            for batch in batches:
                names, y = batch.column("names").flatten().to_pylist(), batch.column("y").to_numpy(zero_copy_only=False)
                ids = [np.array([own.get(v, len(own)) for v in names[j::n_cats]], float)[:, None] for j, own in enumerate(dictionaries)]
                x = np.concatenate([matrix(batch.column("x"), d - n_cats), *ids], 1)
                score = np.tile(init, (len(x), 1))
                for t in range(len(trees) + 1):
                    if t:
                        centre = means.copy()
                        for f, ranks in trees[t - 1].ranks.items():
                            centre[f] = (len(ranks) - 1) / 2
                        score = score + rate * values(trees[t - 1], x, centre, k)
                    sums[t] += [loss_of(kind, score, y, delta).sum(), (score.argmax(1) == y).sum(), len(y)]
            yield pa.record_batch([pa.array(range(len(sums)), pa.int32()), *(pa.array(c) for c in sums.T)], ["trees", "loss", "right", "n"])

        y = F.col(f"`{self.getOrDefault('labelCol')}`").cast("double")
        x, names = self._inputs()
        rows = df.select(x.alias("x"), names.alias("names"), y.alias("y")).where("y is not null and not isnan(y)")
        sums = rows.mapInArrow(work, "trees int, loss double, right double, n double").groupBy("trees").agg(*[F.sum(c).alias(c) for c in ("loss", "right", "n")])
        right = F.try_divide("right", "n") if self.classification else F.lit(None).cast("double")
        return sums.select("trees", F.try_divide("loss", "n").alias("loss"), right.alias("accuracy"))

    def margins(self) -> list[Column]:
        """The scores as expressions: for few trees on numeric features, and for SQL."""
        rate = self.getOrDefault("learningRate")
        return [sum((rate * tree_value(t.nodes, i, self.numeric, self.means) for t in self.trees), F.lit(float(v))) for i, v in enumerate(self.init)]

    def _transform(self, df: DataFrame) -> DataFrame:
        if not self.classification:
            return df.withColumn("prediction", self.margin(df)[0])
        own = [c for c in df.columns if c not in ("rawPrediction", "probability", "prediction")]
        out = df.select(*[F.col(f"`{c}`") for c in own], self.margin(df).alias("rawPrediction"))
        top = F.array_max("rawPrediction")
        powers = F.transform("rawPrediction", lambda m: F.exp(m - top))
        out = out.withColumn("probability", F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda s, p: s + p)))
        return out.withColumn("prediction", decided(F.col("probability"), self.prior, self.getOrDefault("priorAlpha") if self.getOrDefault("balanced") else 0.0))

    def metrics_table(self, spark: SparkSession) -> DataFrame:
        """round, loss, accuracy: the validation rows after each round's trees; empty without validation rows."""
        return spark.createDataFrame([(m["round"], float(m["loss"]), m["accuracy"]) for m in self.metrics], "round int, loss double, accuracy double")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)

    def split_records(self, spark: SparkSession) -> DataFrame:
        """One row per split: tree_id, node_id, depth, w, threshold, gain, family."""
        rows = [(t, n.id, int(math.log2(n.id + 1)), n.w, n.threshold, float(n.gain), n.family) for t, tree in enumerate(self.trees) for n in tree.nodes.values() if not n.is_leaf]
        return spark.createDataFrame(rows, "tree_id int, node_id int, depth int, w array<double>, threshold double, gain double, family string")

    def save_tables(self, spark: SparkSession, path: str) -> None:
        """Parquet for trees, ranks and dictionaries, JSON for the rest."""
        for c, part in enumerate(self.parts):
            part.save_tables(spark, f"{path}/part{c}")
        trees = [(t, n.id, n.leaf, n.w, n.threshold, n.nan_left, float(n.gain), n.family) for t, tree in enumerate(self.trees) for n in tree.nodes.values()]
        spark.createDataFrame(trees, "tree_id int, node_id int, leaf array<double>, w array<double>, threshold double, nan_left boolean, gain double, family string").write.mode("overwrite").parquet(f"{path}/trees")
        ranks = [(t, f, r) for t, tree in enumerate(self.trees) for f, r in tree.ranks.items()]
        spark.createDataFrame(ranks, "tree_id int, f int, ranks array<double>").write.mode("overwrite").parquet(f"{path}/ranks")
        words = [(j, v, i) for j, own in enumerate(self.dictionaries) for v, i in own.items()]
        spark.createDataFrame(words, "f int, value string, id int").write.mode("overwrite").parquet(f"{path}/categories")
        meta = {"init": self.init, "prior": self.prior, "means": self.means, "classification": self.classification, "numeric": self.numeric, "cats": self.cats, "losses": self.losses, "metrics": self.metrics, "parts": len(self.parts), "params": {p.name: v for p, v in self.extractParamMap().items()}}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load_tables(cls, spark: SparkSession, path: str) -> ObliqueModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        trees: dict[int, Tree] = {}
        for r in spark.read.parquet(f"{path}/trees").collect():  # the model, not data
            trees.setdefault(r["tree_id"], Tree({})).nodes[r["node_id"]] = Node(r["node_id"], list(r["leaf"]), list(r["w"]), r["threshold"], r["nan_left"], r["gain"], r["family"])
        for r in spark.read.parquet(f"{path}/ranks").collect():
            trees[r["tree_id"]].ranks[r["f"]] = list(r["ranks"])
        words: list[dict[str, int]] = [{} for _ in meta["cats"]]
        for r in spark.read.parquet(f"{path}/categories").collect():
            words[r["f"]][r["value"]] = r["id"]
        parts = [cls.load_tables(spark, f"{path}/part{c}") for c in range(meta["parts"])]
        model = cls([trees[t] for t in sorted(trees)], meta["init"], meta["prior"], meta["means"], meta["classification"], meta["numeric"], meta["cats"], words, meta["losses"], parts, meta["metrics"])
        model._set(**meta["params"])
        return model


class _ModelWriter(MLWriter):
    """Params as pyspark.ml writes them, and the tables of the model beside them; so a fitted Pipeline can be saved."""

    def __init__(self, model: ObliqueModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.save_tables(self.sparkSession, f"{path}/tables")


class _ModelReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> ObliqueModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind.load_tables(self.sparkSession, f"{path}/tables")
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def decided(probability: Column, prior: list[float], alpha: float = 0.0) -> Column:
    """The first class of largest probability, each divided by its prior to the power alpha."""
    weights = F.array(*[F.lit(1.0 / v**alpha if v and alpha else 1.0) for v in prior])
    scores = F.zip_with(probability, weights, lambda p, w: p * w)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
