"""Whole trees of other shapes: exact thresholds on sorted values, and oblivious trees whose levels share a direction."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from slantree.operators import ordered, shapes, splits
from slantree.plans.trees import Node, Tree, goes_left

EPS = splits.EPS


def node_of(tree: dict[int, Node], cols: list[str]) -> Column:
    """The leaf of each row as an expression; features without missing values."""

    def walk(t: int) -> Column:
        if tree[t].is_leaf:
            return F.lit(t)
        return F.when(goes_left(tree[t], cols, [0.0] * len(cols)), walk(2 * t + 1)).otherwise(walk(2 * t + 2))

    return walk(0)


def exact_cuts(df: DataFrame, cols: Sequence[str], lam: float = 1.0, steps: int = 64, least: float = 0.1, node: str = "node", g: str = "g0", h: str = "h0") -> DataFrame:
    """node, f, v, threshold, gain: cuts between sorted distinct values of each node and feature, about `steps` of them.

    One pass for all nodes: values are summed first, and the running sums of a
    node and feature go over ranges of the feature, so no task sorts a whole node.
    """
    melted = df.select(node, g, h, F.inline(F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).cast("double").alias("v")) for k, c in enumerate(cols)])))
    values = melted.groupBy(node, "f", "v").agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count("*").alias("n"))
    part = F.lit(0)
    for k, c in enumerate(cols):
        part = F.when(F.col("f") == k, ordered.part_of(df.select(F.col(c).cast("double").alias("v")), "v")).otherwise(part)
    runs = ordered.running_by(values.withColumn("_part", part), [node, "f"], "_part", "v", ["g", "h", "n"])
    totals = values.groupBy(node, "f").agg(F.sum("g").alias("tg"), F.sum("h").alias("th"), F.sum("n").alias("tn"))
    step = F.greatest(F.lit(1), F.floor(F.col("tn") / steps))
    tried = runs.join(totals, [node, "f"]).where((F.floor(F.col("run_n") / step) > F.floor((F.col("run_n") - F.col("n")) / step)) & (F.col("run_n") < F.col("tn")))
    fair = tried.where((F.col("run_h") >= least) & (F.col("th") - F.col("run_h") >= least))
    gain = shapes.newton("run_g", "run_h", lam) + shapes.newton(F.col("tg") - F.col("run_g"), F.col("th") - F.col("run_h"), lam) - shapes.newton("tg", "th", lam)
    return fair.select(node, "f", "v", ((F.col("v") + F.col("next_v")) / 2).alias("threshold"), gain.alias("gain"))


def exact_tree(df: DataFrame, cols: list[str], depth: int, lam: float = 1.0, steps: int = 64, least_rows: int = 4, g: str = "g0", h: str = "h0") -> Tree:
    """A tree on exact thresholds: a node of fewer than `least_rows` rows, at `depth`, or without a gain is a leaf of value -G / (H + lambda)."""
    tree = {0: Node(0, [0.0])}
    for level in range(depth):
        rows = df.withColumn("node", node_of(tree, cols))
        sizes = {r["node"]: r["n"] for r in rows.groupBy("node").agg(F.count("*").alias("n")).collect()}  # a row per node
        open_ = [t for t in range(2**level - 1, 2 ** (level + 1) - 1) if sizes.get(t, 0) >= least_rows]
        if not open_:
            break
        cuts = exact_cuts(rows.where(F.col("node").isin(open_)), cols, lam, steps, g=g, h=h).where("gain > 0")
        best = cuts.groupBy("node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("v")).alias("v"), "threshold")).alias("t")).select("node", "t.*")
        for r in best.collect():
            t, w = r["node"], [0.0] * len(cols)
            w[-r["f"]] = 1.0
            tree[t] = Node(t, [0.0], w, r["threshold"], True, r["gain"], "axis")
            for c in (2 * t + 1, 2 * t + 2):
                tree[c] = Node(c, [0.0])
    sums = df.groupBy(node_of(tree, cols).alias("node")).agg(F.sum(g).alias("G0"), F.sum(h).alias("H0"))
    for r in splits.leaf_values(sums, 1, lam).collect():
        tree[r["node"]].leaf = [float(r["leaf0"])]
    return Tree(tree)


@dataclass
class ObliviousTree:
    """One direction per level; thresholds per node of the level, or one for all; a leaf per bit code."""

    cols: list[str]
    directions: list[list[float]] = field(default_factory=list)
    thresholds: list[list[float]] = field(default_factory=list)  # one value, or one per code so far; None sends all to the left
    leaves: list[float] = field(default_factory=list)

    def code(self, levels: int | None = None) -> Column:
        """The leaf of a row: a bit per level, the first one highest, set where the projection is not below the threshold."""
        code = F.lit(0)
        for w, thresholds in list(zip(self.directions, self.thresholds))[:levels]:
            edge = F.lit(thresholds[0]).cast("double") if len(thresholds) == 1 else F.element_at(F.array(*[F.lit(v).cast("double") for v in thresholds]), code + 1)
            right = F.coalesce(splits.project(w, self.cols) >= edge, F.lit(False))
            code = code * 2 + right.cast("int")
        return code

    def score(self) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in self.leaves]), self.code() + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"cols": self.cols, "directions": self.directions, "thresholds": self.thresholds, "leaves": self.leaves})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ObliviousTree:
        return cls(**json.loads(spark.read.text(path).first()[0]))


def oblivious_tree(df: DataFrame, cols: list[str], directions: Sequence[Sequence[float]], depth: int, shared: bool = False, lam: float = 1.0, bins: int = 64, least_rows: int = 8, g: str = "g0", h: str = "h0") -> ObliviousTree:
    """Level by level the direction with the largest sum of gains over all nodes.

    With `shared`, the level has one threshold, of 19 pooled quantiles; else
    each node has its own best of `bins` equal widths, and nodes of fewer than
    `least_rows` rows take none and send all rows to the left.
    """
    out = ObliviousTree(list(cols))
    # Pooled quantiles are those of all rows, whatever the level.
    pooled = [ordered.quantiles(df.select(splits.project(w, cols).alias("p")), "p", [k / 20 for k in range(1, 20)]) for w in directions] if shared else []
    for level in range(depth):
        rows = df.withColumn("node", out.code())
        if shared:
            found = []
            for k, w in enumerate(directions):
                top = shapes.pooled_split(rows.withColumn("p", splits.project(w, cols)), "p", lam, g=g, h=h, edges=pooled[k]).first()
                found.append((top["gain"] or 0.0, -k, top["threshold"]))
            gain, k, threshold = max(found)
            out.directions.append(list(directions[-k]))
            out.thresholds.append([threshold])
            continue
        renamed = rows.withColumnsRenamed({g: "g0", h: "h0"})
        hist = splits.oblique_histogram(splits.project_all(renamed, directions, cols, ["node", "g0", "h0"]), 1, bins)
        sizes = hist.where("dir = 0").groupBy("node").agg(F.sum("n").alias("rows")).where(F.col("rows") >= least_rows)
        cuts = splits.scan(hist.join(F.broadcast(sizes), "node"), 1, bins + 1, lam, min_rows=1, key="dir").where("gain > 0").persist()  # nodes x directions x bins rows
        pick = shapes.oblivious_split(cuts).first()
        k = pick["dir"] if pick["dir"] is not None else 0
        best = cuts.where(F.col("dir") == k).groupBy("node").agg(F.max(F.struct("gain", -F.col("bin"))).alias("t"), F.max_by("bin", F.struct("gain", -F.col("bin"))).alias("bin"))
        edges = hist.where(F.col("dir") == k).groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        own = {r["node"]: r["threshold"] for r in best.join(edges, "node").select("node", (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo") + EPS) / bins).alias("threshold")).collect()}  # a row per node
        cuts.unpersist()
        out.directions.append(list(directions[k]))
        out.thresholds.append([own.get(t) for t in range(2**level)])
    sums = df.groupBy(out.code().alias("code")).agg(F.sum(g).alias("G0"), F.sum(h).alias("H0"))
    values = {r["code"]: float(r["leaf0"]) for r in splits.leaf_values(sums, 1, lam).collect()}  # 2 ** depth rows
    out.leaves = [values.get(c, 0.0) for c in range(2**depth)]
    return out
