"""Experiments: datasets x repetitions x models, and the choice of parameters by successive halving."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantree.operators.gradients import uniform

CELL = "dataset string, rep int, model string, value double, seconds double, error string"


def accuracy(scored: DataFrame, label: str) -> float:
    """Share of rows whose prediction is their label."""
    return float(scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0] or 0.0)


def squared_error(scored: DataFrame, label: str) -> float:
    return float(scored.agg(F.avg(F.pow(F.col("prediction") - F.col(label), 2))).first()[0] or 0.0)


def split(df: DataFrame, key: str, rep: int, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a repetition, by a hash of the key: the same in every run, without a shuffle."""
    u = uniform(F.col(key).cast("string"), f"rep{rep}")
    return df.where(u >= share), df.where(u < share)


def run_cells(datasets: dict[str, DataFrame | Callable[[], DataFrame]], models: dict[str, Estimator | Callable[[], Estimator]], key: str, reps: int = 1, metric: Callable[[DataFrame, str], float] = accuracy, share: float = 0.2, spark=None) -> DataFrame:
    """One row per dataset, repetition and model: the metric on held-out rows and the seconds of the fit.

    A cell that fails (a dataset that cannot be read, a model that cannot be
    made or fitted) is a row too, with the error's first line instead of a
    value; the others run on.
    """
    rows = []
    for dataset, source in datasets.items():
        for rep in range(reps):
            for name, model in models.items():
                began = time.time()
                try:
                    df = source() if callable(source) else source
                    spark = spark or df.sparkSession
                    train, test = split(df, key, rep, share)
                    est = model() if not isinstance(model, Estimator) else model.copy()
                    fitted = est.fit(train, {est.seed: est.getOrDefault("seed") + rep} if est.hasParam("seed") else None)
                    took = time.time() - began
                    rows.append((dataset, rep, name, float(metric(fitted.transform(test), est.getOrDefault("labelCol"))), took, None))
                except Exception as problem:  # a cell's failure is a result
                    rows.append((dataset, rep, name, None, time.time() - began, f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}"))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, CELL)


def successive_halving(df: DataFrame, estimator: Estimator, grid: Sequence[dict], key: str, metric: Callable[[DataFrame, str], float] = accuracy, larger: bool = True, least_share: float = 0.125, share: float = 0.2) -> tuple[dict, DataFrame]:
    """The best parameters of a grid, and what each rung found: rung, row share, parameters (number in the grid), value.

    All candidates are fitted on a small share of the training rows; the better
    half goes on to twice the rows, until one is left or all rows are used.  The
    samples are nested (a row's hash decides), and the held-out rows are the same
    for all.
    """
    train, test = split(df, key, 0, share)
    u = uniform(F.col(key).cast("string"), "rung")
    left, part, rung, found = list(range(len(grid))), least_share if len(grid) > 1 else 1.0, 0, []
    while True:
        rows = (train.where(u < part) if part < 1 else train).persist()
        values = {}
        for k in left:
            est = estimator.copy({estimator.getParam(name): v for name, v in grid[k].items()})
            values[k] = float(metric(est.fit(rows).transform(test), est.getOrDefault("labelCol")))
            found.append((rung, float(part), k, values[k]))
        rows.unpersist()
        left.sort(key=lambda k: (-values[k] if larger else values[k], k))
        if len(left) == 1 or part >= 1:
            return grid[left[0]], df.sparkSession.createDataFrame(found, "rung int, share double, params int, value double")
        left, part, rung = left[: -(-len(left) // 2)], min(1.0, 2 * part), rung + 1
