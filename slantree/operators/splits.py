"""Split search: histograms, prefix sums, gains, argmax, oblique projections, leaves.

Rows carry `node`, one code column per feature and g/h columns per class.  All
shuffles are keyed by (node, feature, bin) or (node, direction, bin) after a
map-side combine, so their size follows nodes x features x bins, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

EPS = 1e-8


def names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(k)]


def shrink(g: Column, alpha: float) -> Column:
    """The L1 threshold of a gradient sum."""
    return F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0)) if alpha else g


def side_score(g: Sequence[Column], h: Sequence[Column], lam: float = 1.0, alpha: float = 0.0) -> Column:
    parts = [shrink(a, alpha) * shrink(a, alpha) / (b + lam + EPS) for a, b in zip(g, h)]
    return sum(parts[1:], parts[0])


def histogram(df: DataFrame, codes: Sequence[str], k: int, node: str = "node", key: str = "f") -> DataFrame:
    """node, f, bin, G_k, H_k, n: sums of gradients by node, feature and bin."""
    pairs = F.array(*[F.struct(F.lit(i).alias(key), F.col(c).cast("int").alias("bin")) for i, c in enumerate(codes)])
    rows = df.select(node, *names("g", k), *names("h", k), F.inline(pairs))
    return rows.groupBy(node, key, "bin").agg(*[F.sum(f"g{i}").alias(f"G{i}") for i in range(k)], *[F.sum(f"h{i}").alias(f"H{i}") for i in range(k)], F.count("*").alias("n"))


def subtract(parent: DataFrame, child: DataFrame, k: int) -> DataFrame:
    """The sibling's histogram: parent minus child, joined on (f, bin)."""
    cols = [*names("G", k), *names("H", k), "n"]
    right = child.select("f", "bin", *[F.col(c).alias(f"c_{c}") for c in cols])
    return parent.join(right, ["f", "bin"], "full").select("f", "bin", *[(F.coalesce(c, F.lit(0)) - F.coalesce(f"c_{c}", F.lit(0))).alias(c) for c in cols])


def scan(hist: DataFrame, k: int, bins: int, lam: float = 1.0, alpha: float = 0.0, min_rows: int = 10, min_weight: float = 0.0, node: str = "node", key: str = "f", sums: bool = False) -> DataFrame:
    """Every admissible cut: node, f, bin, nan_left, gain, n_left, n_right; with `sums` also the left and whole G and H.

    Left of a cut are bins up to it; the missing bin (bins - 1) is tried on both
    sides.  A side needs min_rows rows and min_weight hessian.
    """
    # Written as SQL text: a fit plans this once per level, and each call into the JVM would cost more than the plan.
    cols = [*names("G", k), *names("H", k), "n"]
    own = f"partition by `{node}`, `{key}`"
    missing = [f"coalesce(sum(case when bin = {bins - 1} then {c} end) over ({own}), 0) as m_{c}" for c in cols]
    walked = hist.selectExpr("*", *[f"sum({c}) over ({own}) as t_{c}" for c in cols], *missing).where(f"bin < {bins - 1}")
    run = [f"sum({c}) over ({own} order by bin rows between unbounded preceding and current row) as l_{c}" for c in cols]
    sides = walked.selectExpr("*", *run).selectExpr("*", "explode(case when m_n > 0 then array(1, 0) else array(1) end) as nan_left")
    halves = [f"l_{c} + nan_left * m_{c} as a_{c}" for c in cols] + [f"t_{c} - (l_{c} + nan_left * m_{c}) as z_{c}" for c in cols]
    split = sides.selectExpr(f"`{node}`", f"`{key}`", "bin", "nan_left", *halves, *[f"t_{c}" for c in cols])

    def score(side: str) -> str:
        def squared(g: str) -> str:
            t = f"signum({g}) * greatest(abs({g}) - {alpha!r}D, 0D)" if alpha else g
            return f"({t}) * ({t})"

        return " + ".join(f"{squared(f'{side}_G{i}')} / ({side}_H{i} + {lam!r}D + {EPS!r}D)" for i in range(k))

    weight = {side: " + ".join(f"{side}_{h}" for h in names("H", k)) for side in "az"}
    gain = f"0.5D * (({score('a')}) + ({score('z')}) - ({score('t')})) as gain"
    kept = [f"a_{c} as l_{c}" for c in cols[:-1]] + [f"t_{c}" for c in cols[:-1]] if sums else []
    fair = f"a_n >= {min_rows} and z_n >= {min_rows} and {weight['a']} >= {min_weight!r}D and {weight['z']} >= {min_weight!r}D"
    return split.where(fair).selectExpr(f"`{node}`", f"`{key}`", "bin", "nan_left", gain, "a_n as n_left", "z_n as n_right", *kept)


def best(cuts: DataFrame, node: str = "node", key: str = "f") -> DataFrame:
    """The cut of largest gain per node; ties to the lowest feature, then bin, then missing left."""
    rest = [c for c in cuts.columns if c not in (node, key, "bin", "gain", "nan_left", "n_left", "n_right")]
    rest = ["n_left", "n_right", *rest]
    top = cuts.groupBy(node).agg(F.expr(f"max(struct(gain, -`{key}` as a, -bin as b, nan_left, {', '.join(rest)})) as t"))
    return top.selectExpr(f"`{node}`", f"-t.a as `{key}`", "-t.b as bin", "t.nan_left", "t.gain", *[f"t.{c}" for c in rest])


def totals(df: DataFrame, k: int, node: str = "node", lam: float = 1.0) -> DataFrame:
    """node, G_k, H_k, n and the bound sum_i sum_k g^2 / 2(h + lambda + eps)."""
    bound = sum((0.5 * F.col(f"g{i}") * F.col(f"g{i}") / (F.col(f"h{i}") + lam + EPS) for i in range(1, k)), 0.5 * F.col("g0") * F.col("g0") / (F.col("h0") + lam + EPS))
    return df.groupBy(node).agg(*[F.sum(f"g{i}").alias(f"G{i}") for i in range(k)], *[F.sum(f"h{i}").alias(f"H{i}") for i in range(k)], F.count("*").alias("n"), F.sum(bound).alias("bound"))


def dominant_class(df: DataFrame, k: int, node: str = "node") -> DataFrame:
    """The class with the most absolute gradient per node; the lowest wins ties."""
    masses = df.groupBy(node).agg(*[F.sum(F.abs(f"g{i}")).alias(f"a{i}") for i in range(k)])
    return masses.select(node, (-F.greatest(*[F.struct(F.col(f"a{i}").alias("m"), F.lit(-i).alias("k")) for i in range(k)])["k"]).alias("dominant"))


def sis_scores(df: DataFrame, cols: Sequence[str], g: str, h: str, node: str = "node", lam: float = 1.0) -> DataFrame:
    """|sum x g| / sqrt(sum h x^2 + lambda + eps) and sum x g by node and feature."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(i).alias("f"), F.sum(x * F.col(g)).alias("xg"), (F.abs(F.sum(x * F.col(g))) / F.sqrt(F.sum(F.col(h) * x * x) + lam + EPS)).alias("sis")))
    return df.groupBy(node).agg(F.array(*aggs).alias("s")).select(node, F.inline("s"))


def project(weights: Sequence[float], cols: Sequence[str]) -> Column:
    """w . x as one expression; only the nonzero terms."""
    terms = [F.col(c) * F.lit(float(w)) for w, c in zip(weights, cols) if w]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def project_all(df: DataFrame, directions: Sequence[Sequence[float]], cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep, dir, p: all projections of each row by one narrow explode (the directions are few and literal)."""
    items = F.array(*[F.struct(F.lit(d).alias("dir"), project(w, cols).alias("p")) for d, w in enumerate(directions)])
    return df.select(*keep, F.inline(items))


def oblique_histogram(projected: DataFrame, k: int, bins: int = 64, node: str = "node") -> DataFrame:
    """node, dir, bin, lo, hi, G_k, H_k, n over `bins` equal widths of each node's and direction's own range."""
    ranges = projected.groupBy(node, "dir").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    rows = projected.join(F.broadcast(ranges), [node, "dir"])  # nodes x directions rows
    b = F.least(F.lit(bins - 1), F.floor((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo") + EPS) * bins)).cast("int")
    return rows.withColumn("bin", b).groupBy(node, "dir", "lo", "hi", "bin").agg(*[F.sum(f"g{i}").alias(f"G{i}") for i in range(k)], *[F.sum(f"h{i}").alias(f"H{i}") for i in range(k)], F.count("*").alias("n"))


def exact_gain(df: DataFrame, goes_left: Column, k: int, lam: float = 1.0, node: str = "node") -> DataFrame:
    """The gain of one split per node on all its rows, by conditional sums."""
    aggs = []
    for i in range(k):
        for p in ("g", "h"):
            aggs += [F.sum(F.when(goes_left, F.col(f"{p}{i}")).otherwise(0.0)).alias(f"l_{p}{i}"), F.sum(f"{p}{i}").alias(f"t_{p}{i}")]
    s = df.groupBy(node).agg(*aggs, F.sum(goes_left.cast("long")).alias("n_left"), F.count("*").alias("n"))

    def score(side: str) -> Column:
        pick = {"l": lambda c: F.col(f"l_{c}"), "t": lambda c: F.col(f"t_{c}"), "r": lambda c: F.col(f"t_{c}") - F.col(f"l_{c}")}[side]
        return side_score([pick(f"g{i}") for i in range(k)], [pick(f"h{i}") for i in range(k)], lam)

    return s.select(node, (0.5 * (score("l") + score("r") - score("t"))).alias("gain"), "n_left", (F.col("n") - F.col("n_left")).alias("n_right"))


def leaf_values(sums: DataFrame, k: int, lam: float = 1.0, alpha: float = 0.0) -> DataFrame:
    return sums.withColumns({f"leaf{i}": -shrink(F.col(f"G{i}"), alpha) / (F.col(f"H{i}") + lam + EPS) for i in range(k)})


def gram(df: DataFrame, cols: Sequence[str], g: str, h: str) -> DataFrame:
    """i, j, xhx for i <= j, and i, -1, xg: the normal equations in one aggregate."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(F.col(h) * F.col(cols[i]) * F.col(cols[j])).alias("v")) for i in range(len(cols)) for j in range(i, len(cols))]
    cells += [F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), F.sum(F.col(c) * F.col(g)).alias("v")) for i, c in enumerate(cols)]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
