"""Losses, gradients, priors and row sampling as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slantree.operators import ordered


def class_priors(df: DataFrame, label: str) -> DataFrame:
    """label, n, prior, centred log prior (the initial score)."""
    counts = df.groupBy(F.col(label).alias("k")).agg(F.count("*").alias("n"))
    every = W.partitionBy()  # as many rows as classes
    out = counts.withColumn("prior", F.col("n") / F.sum("n").over(every)).withColumn("lp", F.log(F.col("prior") + 1e-8))
    return out.withColumn("init", F.col("lp") - F.avg("lp").over(every)).drop("lp")


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    exps = [F.exp(s - top) for s in scores]
    total = sum(exps[1:], exps[0])
    return [e / total for e in exps]


def softmax_gradients(scores: list[Column], label: Column, weight: Column | None = None) -> tuple[list[Column], list[Column]]:
    w = F.lit(1.0) if weight is None else weight
    p = softmax(scores)
    return [(pk - (label == k).cast("double")) * w for k, pk in enumerate(p)], [pk * (1 - pk) * w for pk in p]


def regression_gradient(loss: str, score: Column, y: Column, delta: float = 1.0) -> Column:
    error = score - y
    if loss in ("squared_error", "l2"):
        return error
    if loss in ("absolute_error", "l1"):
        return F.signum(error)
    if loss == "huber":
        return F.least(F.greatest(error, F.lit(-delta)), F.lit(delta))
    raise ValueError(f"unknown loss {loss}")


def uniform(key: Column, stream: str = "") -> Column:
    """A reproducible number in [0, 1) from a row's key: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(stream), key)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def goss(df: DataFrame, score: str, key: str, a: float, b: float, stream: str = "goss") -> DataFrame:
    """Gradient-based one-side sampling: rows kept, and `amplify` (1, or (1 - a) / b for the sampled rest).

    The int(a n) largest scores stay (ties by key), and int(b (n - int(a n)))
    of the rest by their reproducible uniform numbers, without replacement; if
    a part would be empty all rows stay with factor 1.
    """
    n = df.count()
    top = int(a * n)
    rest = int(b * (n - top))
    if top == 0 or rest == 0:
        return df.withColumn("amplify", F.lit(1.0))
    marked = df.withColumn("_top", ordered.first_n(df, top, score, key, descending=True, total=n))
    marked = marked.withColumn("_u", uniform(F.col(key).cast("string"), stream))
    keep = ordered.first_n(marked.where(~F.col("_top")), rest, "_u", key, total=n - top)
    return marked.where(F.col("_top") | keep).withColumn("amplify", F.when(F.col("_top"), F.lit(1.0)).otherwise(F.lit((1 - a) / b))).drop("_top", "_u")


def bernoulli(df: DataFrame, key: str, share: float, stream: str = "sub") -> DataFrame:
    """Rows with u < share; all rows if fewer than min(n, 1000) would stay."""
    kept = df.where(uniform(F.col(key).cast("string"), stream) < share)
    return kept if kept.count() >= min(df.count(), 1000) else df


def without_replacement(df: DataFrame, key: str, n: int, stream: str = "ns") -> DataFrame:
    """n rows by the least uniform numbers, ties by key."""
    drawn = df.withColumn("_u", uniform(F.col(key).cast("string"), stream))
    return drawn.where(ordered.first_n(drawn, n, "_u", key)).drop("_u")


def stratified(df: DataFrame, label: str, key: str, share: float, stream: str = "split") -> DataFrame:
    """Add `part`: test for int(share x n) rows of each class by uniform number (ties by key), train for the others."""
    drawn = df.withColumn("_u", uniform(F.col(key).cast("string"), stream))
    test = F.lit(False)
    for row in df.groupBy(label).agg(F.count("*").alias("n")).collect():  # one row per class
        own = F.col(label).eqNullSafe(F.lit(row[label]))
        test = test | (own & ordered.first_n(drawn.where(own), int(share * row["n"]), "_u", key, total=row["n"]))
    return drawn.withColumn("part", F.when(test, "test").otherwise("train")).drop("_u")


def stride(df: DataFrame, key: str, n: int, cap: int = 2048) -> DataFrame:
    """At most `cap` of `n` rows at even steps of the order of `key` (a number): those numbered floor(i n / cap)."""
    if n <= cap:
        return df
    place = ordered.running(df.withColumn("_one", F.lit(1)), key, ["_one"]).withColumn("_i", F.col("run__one") - 1)
    # Row i is taken if some k has floor(k n / cap) = i, which is so for k = ceil(i cap / n).
    k = F.floor((F.col("_i") * cap + n - 1) / F.lit(n))
    return place.where((k < cap) & (F.floor(k * n / F.lit(cap)) == F.col("_i"))).drop("_one", "run__one", "_i")


def huber_loss(score: Column, y: Column, delta: float = 1.0) -> Column:
    e = F.abs(score - y)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def initial_value(df: DataFrame, loss: str, y: str, weight: str | None = None) -> float:
    """Mean for squared error; else the median, or the weighted lower median.  Without rows or weight it is 0."""
    if loss in ("squared_error", "l2"):
        mean = df.agg(F.avg(y) if weight is None else F.try_divide(F.sum(F.col(y) * F.col(weight)), F.sum(weight))).first()[0]
        return float(mean or 0.0)
    if weight is None:
        return float(ordered.quantiles(df, y, [0.5])[0] or 0.0)
    runs = ordered.running(df.groupBy(y).agg(F.sum(weight).alias("w")), y, ["w"])
    total = df.agg(F.sum(weight)).first()[0]
    return float(runs.where(F.col("run_w") >= total / 2).agg(F.min(y)).first()[0]) if total else 0.0
