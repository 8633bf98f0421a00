"""Further tree shapes and searches: exact thresholds on sorted rows, shared (oblivious) splits, blends, smoothing, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slantree.operators import ordered, splits

EPS = splits.EPS


def newton(g: Column | str, h: Column | str, lam: float) -> Column:
    g, h = (F.col(c) if isinstance(c, str) else c for c in (g, h))
    return 0.5 * g * g / (h + lam + EPS)


def sorted_threshold(df: DataFrame, p: str, g: str = "g0", h: str = "h0", lam: float = 1.0, steps: int = 64, least: float = 0.1) -> DataFrame:
    """The best cut between rows sorted by projection `p`: threshold (midpoint), gain, n_left.

    Rows of equal projection stay on one side.  About `steps` cuts are tried,
    at the distinct values that end every max(1, n // steps)-th row.
    """
    values = df.groupBy(p).agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count("*").alias("n"))
    total = df.agg(F.sum(g).alias("tg"), F.sum(h).alias("th"), F.count("*").alias("tn")).first()
    if not total["tn"]:
        return df.sparkSession.createDataFrame([], "threshold double, gain double, n_left long")
    step = max(1, total["tn"] // steps)
    runs = ordered.running(values, p, ["g", "h", "n"])
    # The next value up, for the midpoint: the least one of which fewer rows lie below.
    tried = runs.where((F.floor(F.col("run_n") / step) > F.floor((F.col("run_n") - F.col("n")) / step)) & (F.col("run_n") < total["tn"]))
    th, tg = F.lit(total["th"]), F.lit(total["tg"])
    fair = tried.where((F.col("run_h") >= least) & (th - F.col("run_h") >= least))
    gain = newton("run_g", "run_h", lam) + newton(tg - F.col("run_g"), th - F.col("run_h"), lam) - newton(tg, th, lam)
    top = fair.agg(F.max(F.struct(gain.alias("gain"), (-F.col(p)).alias("v"), F.col("run_n").alias("n_left"))).alias("t")).select("t.gain", (-F.col("t.v")).alias("_v"), "t.n_left")
    following = values.join(F.broadcast(top), F.col(p) > F.col("_v")).agg(F.min(p).alias("_next"))
    return top.crossJoin(F.broadcast(following)).select(((F.col("_v") + F.col("_next")) / 2).alias("threshold"), "gain", "n_left")  # one row each


def oblivious_split(cuts: DataFrame, key: str = "dir") -> DataFrame:
    """The direction that all nodes of a level share: the one with the largest sum of the nodes' best gains, and that sum."""
    per_node = cuts.groupBy("node", key).agg(F.max("gain").alias("gain"))
    sums = per_node.groupBy(key).agg(F.sum("gain").alias("gain"))
    return sums.agg(F.max(F.struct("gain", (-F.col(key)).alias("a"))).alias("t")).select((-F.col("t.a")).alias(key), F.col("t.gain").alias("gain"))


def leaf_code(tests: Sequence[Column]) -> Column:
    """The leaf of an oblivious tree: one bit per level, the first level highest; a null test counts as false."""
    code = F.lit(0)
    for test in tests:
        code = code * 2 + F.coalesce(test, F.lit(False)).cast("int")
    return code


def pooled_split(df: DataFrame, p: str, lam: float = 1.0, shares: Sequence[float] = tuple(k / 20 for k in range(1, 20)), min_rows: int = 4, node: str = "node", g: str = "g0", h: str = "h0", edges: Sequence[float] | None = None) -> DataFrame:
    """One direction and one threshold for all nodes: the pooled quantile (or one of `edges`) with the largest sum of gains; a side needs min_rows."""
    edges = ordered.quantiles(df, p, shares) if edges is None else edges
    aggs = [F.sum(g).alias("tg"), F.sum(h).alias("th"), F.count("*").alias("tn")]
    for k, edge in enumerate(edges):
        left = F.col(p) < F.lit(edge)
        aggs += [F.sum(F.when(left, F.col(g)).otherwise(0.0)).alias(f"g{k}"), F.sum(F.when(left, F.col(h)).otherwise(0.0)).alias(f"h{k}"), F.sum(left.cast("long")).alias(f"n{k}")]
    sums = df.groupBy(node).agg(*aggs)
    gains = []
    for k, edge in enumerate(edges):
        gain = newton(F.col(f"g{k}"), F.col(f"h{k}"), lam) + newton(F.col("tg") - F.col(f"g{k}"), F.col("th") - F.col(f"h{k}"), lam) - newton("tg", "th", lam)
        fair = (F.col(f"n{k}") >= min_rows) & (F.col("tn") - F.col(f"n{k}") >= min_rows)
        gains.append(F.struct(F.lit(k).alias("k"), F.lit(edge).alias("threshold"), F.when(fair, gain).otherwise(0.0).alias("gain")))
    per_cut = sums.select(F.inline(F.array(*gains))).groupBy("k", "threshold").agg(F.sum("gain").alias("gain"))
    return per_cut.agg(F.max(F.struct("gain", (-F.col("k")).alias("k"), "threshold")).alias("t")).select("t.threshold", "t.gain")


def blends(first: Sequence[float], second: Sequence[float], shares: Sequence[float] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) -> list[list[float]]:
    """share x first + (1 - share) x second for each share."""
    return [[a * x + (1 - a) * y for x, y in zip(first, second)] for a in shares]


def smoothed(leaves: DataFrame, parents: DataFrame, k: int = 1, lam: float = 1.0, alpha: float = 0.0) -> DataFrame:
    """Leaf values drawn towards the parent's: (H raw + lambda parent) / (H + lambda + eps).

    `leaves` has node, G_k and H_k; `parents` has node and leaf_k.  A node
    without a parent there keeps its raw value.
    """
    above = parents.select(F.col("node").alias("_parent"), *[F.col(f"leaf{i}").alias(f"_p{i}") for i in range(k)])
    raw = splits.leaf_values(leaves, k, lam, alpha).withColumn("_up", F.expr("cast((node - 1) div 2 as int)"))
    both = raw.join(above, F.col("_up") == F.col("_parent"), "left")
    values = {f"leaf{i}": F.when(F.col(f"_p{i}").isNull(), F.col(f"leaf{i}")).otherwise((F.col(f"H{i}") * F.col(f"leaf{i}") + lam * F.col(f"_p{i}")) / (F.col(f"H{i}") + lam + EPS)) for i in range(k)}
    return both.withColumns(values).drop("_up", "_parent", *[f"_p{i}" for i in range(k)])


def feature_mask(nodes: DataFrame, n_features: int, share: float, stream: str = "mask") -> DataFrame:
    """node, f: the max(1, rint(n share)) features that a node may use, by least hash of (stream, node, f)."""
    from slantree.operators.gradients import uniform

    keep = max(1, round(n_features * share))
    pairs = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("f"))
    drawn = pairs.withColumn("_u", uniform(F.concat_ws("-", "node", "f"), stream))
    own = W.partitionBy("node").orderBy("_u", "f")  # as many rows as features
    return drawn.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= keep).select("node", "f")


def category_bin(rank: Column, card: int, bins: int) -> Column:
    """A category's bin from its rank."""
    return F.least(F.lit(bins - 1), F.floor(rank * bins / F.lit(card - 1 + EPS))).cast("int")


def covariance_direction(df: DataFrame, cols: Sequence[str], g: str = "g0") -> DataFrame:
    """f, w: -X'g, normalised to length 1."""
    cells = [F.struct(F.lit(k).alias("f"), (-F.sum(F.col(c) * F.col(g))).alias("w")) for k, c in enumerate(cols)]
    raw = df.agg(F.array(*cells).alias("a"))
    size = F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return raw.select(F.inline(F.transform("a", lambda x: F.struct(x["f"].alias("f"), (x["w"] / size).alias("w")))))


def gradient_variance(df: DataFrame, g: str = "g0", node: str = "node") -> DataFrame:
    """Sum of squared deviations of the gradient over its sum of squares, by node."""
    return df.groupBy(node).agg((F.var_pop(g) * F.count(g) / F.sum(F.col(g) * F.col(g))).alias("variance"))
