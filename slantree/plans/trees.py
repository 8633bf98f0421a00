"""Trees: nodes, routing as column expressions (one tree) and in Arrow batches (a whole model)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    id: int  # heap position: the children of t are 2 t + 1 and 2 t + 2
    leaf: list[float]
    w: list[float] = field(default_factory=list)
    threshold: float = 0.0
    nan_left: bool = True
    gain: float = 0.0
    family: str = ""

    @property
    def is_leaf(self) -> bool:
        return not self.w


@dataclass
class Tree:
    nodes: dict[int, Node]
    ranks: dict[int, list[float]] = field(default_factory=dict)  # categorical feature -> rank by id; the last one is the missing or unseen category's


def goes_left(node: Node, cols: list[str], means: list[float]) -> Column:
    """A single feature's missing value takes the side stored with the split; projections use the mean."""
    used = [k for k, w in enumerate(node.w) if w]
    if len(used) == 1:
        x = F.col(cols[used[0]]).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.lit(node.nan_left)).otherwise(x * F.lit(node.w[used[0]]) < F.lit(node.threshold))
    terms = [F.coalesce(F.nanvl(F.col(cols[k]).cast("double"), F.lit(means[k])), F.lit(means[k])) * F.lit(node.w[k]) for k in used]
    return sum(terms[1:], terms[0]) < F.lit(node.threshold)


def tree_value(nodes: dict[int, Node], k: int, cols: list[str], means: list[float], at: int = 0) -> Column:
    node = nodes[at]
    if node.is_leaf:
        return F.lit(float(node.leaf[k]))
    return F.when(goes_left(node, cols, means), tree_value(nodes, k, cols, means, 2 * at + 1)).otherwise(tree_value(nodes, k, cols, means, 2 * at + 2))


def ranked(x: np.ndarray, tree: Tree) -> np.ndarray:
    """Feature rows with category ids replaced by this tree's ranks."""
    if not tree.ranks:
        return x
    x = x.copy()
    for f, ranks in tree.ranks.items():
        ids = np.where(np.isnan(x[:, f]), len(ranks) - 1, x[:, f]).astype(np.int64)
        x[:, f] = np.asarray(ranks)[np.clip(ids, 0, len(ranks) - 1)]
    return x


def left_of(node: Node, x: np.ndarray, means: np.ndarray) -> np.ndarray:
    used = np.flatnonzero(node.w)
    part = x[:, used]
    missing = np.isnan(part)
    if len(used) == 1:
        return np.where(missing[:, 0], node.nan_left, part[:, 0] * node.w[used[0]] < node.threshold)
    # Term by term in the order of the expression form, so that both route every row alike.
    filled = np.where(missing, means[used], part)
    total = filled[:, 0] * node.w[used[0]]
    for j in range(1, len(used)):
        total = total + filled[:, j] * node.w[used[j]]
    return total < node.threshold


def route(nodes: dict[int, Node], x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The leaf of each row; `x` has ranks for categories and NaN for missing values."""
    at = np.zeros(len(x), np.int64)
    for t in sorted(nodes):
        node = nodes[t]
        if node.is_leaf:
            continue
        here = np.flatnonzero(at == t)
        if len(here):
            at[here] = np.where(left_of(node, x[here], means), 2 * t + 1, 2 * t + 2)
    return at


def values(tree: Tree, x: np.ndarray, means: np.ndarray, k: int) -> np.ndarray:
    """rows x K: the leaf values of one tree; `x` has category ids."""
    at = route(tree.nodes, ranked(x, tree), means)
    leaves = sorted(t for t, n in tree.nodes.items() if n.is_leaf)
    table = np.array([tree.nodes[t].leaf for t in leaves]).reshape(len(leaves), k)
    return table[np.searchsorted(leaves, at)]
