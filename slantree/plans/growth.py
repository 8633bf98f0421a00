"""Growing one tree as Spark jobs.

The training table has a row per row of the input: its features, the codes of
its numeric bins, label, weight, a number, and the scores of the trees up to the
last time that they were added up; tasks add what is pending.

A tree grows best first.  `grow` keeps the nodes that have been searched, splits
the one of largest gain, and so on until the leaves are used up.  Where the next
node's children are not known, one job searches them together with the children
of the next best nodes (`AHEAD`): tasks route their rows, sum gradients by
feature and bin for the smaller child of each pair, and the sums go to one task
per node and feature (or to the driver, where they are few).  There the larger child is the parent's sums, kept from
the job before, minus its sibling's; cuts are scanned and the best kept.
Proposed oblique splits are two bins of their own in the same job, and
directions solved from sums over all rows are further histograms, so every gain
is exact and over all rows.

The driver holds a bounded sample of rows, which proposes oblique splits; a node
of too few of them is sampled again, by itself.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantree.plans import directions
from slantree.plans.trees import Node, Tree, left_of, ranked, route, values

#: Bytes of sampled rows that the driver holds, for the table and for the nodes of one job.
SAMPLE_BYTES = 1 << 26
#: Rows of a node in the sample for an oblique search, and its bins.  A node of fewer than ENOUGH sampled rows is sampled by itself.
LEAST_OBLIQUE, OBLIQUE_BINS, ENOUGH = 64, 64, 128
#: Cells of the sums that a task holds, and nodes whose children are searched in one job.
MOST_CELLS, AHEAD = 1 << 23, 32
#: Bytes of a node's sums from all tasks up to which the driver adds them; beyond, they are shuffled to a task per node and feature.
MOST_LOCAL = 1 << 20
#: Rows near the cut of one-side sampling that the driver orders.
MOST_ORDERED = 1 << 19
#: Best cuts that the driver compares itself; of more, one row a node is picked by Spark.
MOST_COMPARED = 1 << 12
#: Features that a direction solved from a node's normal equations may use.
MOST_SOLVED = 16
#: Columns of the training table; they do not clash, since no column of the input stays.
STATE = "x array<double>, code binary, y double, w double, valid boolean, number long, score array<double>"
FOUND = "node long, f int, bin int, nan_left int, gain double, n_left long, n_right long, left_sums array<double>, total_sums array<double>, cells binary"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """rows x width of an array column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def byte_matrix(column: pa.Array, width: int) -> np.ndarray:
    """rows x width of a binary column whose values all have `width` bytes."""
    if not len(column) or not width:
        return np.zeros((len(column), width), np.uint8)
    edge = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[edge[0] : edge[-1]].reshape(len(column), width)


def hashed(number: np.ndarray, stream: int) -> np.ndarray:
    """64 reproducible random bits per row."""
    z = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((stream * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(number: np.ndarray, stream: int) -> np.ndarray:
    """A reproducible number in [0, 1) per row."""
    return hashed(number, stream).astype(float) / 2.0**64


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients_of(kind: str, score: np.ndarray, y: np.ndarray, w: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """G and H, rows x K, weights included."""
    if kind == "softmax":
        p = softmax(score)
        g, h = p - (np.arange(score.shape[1]) == y[:, None]), p * (1 - p)
    else:
        e = score - y[:, None]
        g = e if kind in ("squared_error", "l2") else np.sign(e) if kind in ("absolute_error", "l1") else np.clip(e, -delta, delta)
        h = np.ones_like(e)
    return g * w[:, None], h * w[:, None]


def loss_of(kind: str, score: np.ndarray, y: np.ndarray, delta: float) -> np.ndarray:
    if kind == "softmax":
        return -np.log(np.maximum(softmax(score)[np.arange(len(y)), y.astype(int)], 1e-8))
    e = np.abs(score[:, 0] - y)
    if kind in ("squared_error", "l2"):
        return e * e
    return e if kind in ("absolute_error", "l1") else np.where(e <= delta, 0.5 * e * e, delta * (e - 0.5 * delta))


class Round:
    """What the tasks of one round need: how to grade rows, which rows count, how values are binned."""

    def __init__(self, stats: list[dict], cats: dict[int, int], k: int, kind: str, p: dict, stream: int, pending: list | None = None, parts: int = 1 << 30):
        self.lo, self.hi, self.means = (np.array([s[c] for s in stats], float) for c in ("lo", "hi", "mean"))
        self.active = np.array([s["active"] for s in stats], bool)
        self.cats, self.k, self.kind, self.p, self.stream = cats, k, kind, p, stream
        self.pending = pending or []  # (tree, rate, means) not yet in the table's scores
        self.cut: tuple[int, int, int] | None = None  # one-side sampling: least key that is always kept, and where the hashes of the others stop
        self.numeric = [f for f in range(len(self.lo)) if f not in cats]
        self.parts, self.local = parts, False  # partitions of the table, and whether the driver may add the tasks' sums

    def scored(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        for tree, rate, means in self.pending:
            score = score + rate * values(tree, x, means, self.k)
        return score

    def graded(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """x, codes, g, h and numbers of a batch's training rows."""
        d = len(self.lo)
        x, score = matrix(batch.column("x"), d), matrix(batch.column("score"), self.k if self.kind != "given" else 2 * self.k)
        code = byte_matrix(batch.column("code"), len(self.numeric))
        y, w, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "number"))
        keep = ~batch.column("valid").to_numpy(zero_copy_only=False)
        if not keep.all():
            x, code, score, y, w, number = x[keep], code[keep], score[keep], y[keep], w[keep], number[keep]
        if self.kind == "given":  # gradients of the caller's own objective stand in for the scores
            return x, code, score[:, : self.k], score[:, self.k :], number
        return x, code, *gradients_of(self.kind, self.scored(x, score), y, w, self.p["delta"]), number

    def keys(self, g: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of one-side sampling: the bits of the mean |g| (they ascend with it), a hash for its ties, and a hash that draws the others."""
        return np.abs(g).mean(1).view(np.int64), (hashed(number, 3 * self.stream + 1) >> np.uint64(1)).view(np.int64), (hashed(number, 3 * self.stream + 2) >> np.uint64(1)).view(np.int64)

    def chosen(self, g: np.ndarray, h: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows the round uses, and their factors."""
        ones = np.ones(len(g))
        if self.cut is not None:
            a, b = self.p["goss"]
            size, tie, other = self.keys(g, number)
            top = (size > self.cut[0]) | ((size == self.cut[0]) & (tie >= self.cut[1]))
            return top | (other < self.cut[2]), np.where(top, 1.0, (1 - a) / b)
        if self.p["subsample"] < 1:
            return uniform(number, 3 * self.stream + 2) < self.p["subsample"], ones
        return np.ones(len(g), bool), ones

    def used(self, batch: pa.RecordBatch, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """x with ranks, codes of all features, [g, h, 1] with factors, and numbers of the rows that the round uses."""
        x, code, g, h, number = self.graded(batch)
        keep, factor = self.chosen(g, h, number)
        x, code, number = x[keep], code[keep], number[keep]
        sums = np.concatenate([g[keep] * factor[keep, None], h[keep] * factor[keep, None], np.ones((len(x), 1))], 1)
        x = ranked(x, tree)
        codes = np.empty((len(x), len(self.lo)), np.int64)
        codes[:, self.numeric] = code
        for f in self.cats:
            card = len(tree.ranks[f])
            codes[:, f] = np.minimum(self.p["bins"] - 2, (x[:, f] * (self.p["bins"] - 1) / (card - 1 + 1e-8)).astype(np.int64))
        return x, codes, sums, number

    def edge(self, f: int, b: int, tree: Tree) -> float:
        """The upper edge of bin b: values below it are the bins up to b."""
        if f in self.cats:
            return (b + 1) * (len(tree.ranks[f]) - 1 + 1e-8) / (self.p["bins"] - 1)
        return float(self.lo[f] + (b + 1) * (self.hi[f] - self.lo[f] + 1e-8) / (self.p["bins"] - 1))

    def scales(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """Centre and width by which features are scaled in a search for directions."""
        centre, width = self.means.copy(), self.hi - self.lo + 1e-8
        for f, ranks in tree.ranks.items():
            centre[f], width[f] = (len(ranks) - 1) / 2, max(1, len(ranks) - 1)
        return centre, width


def bin_codes(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """Bins of numeric features as bytes; the last one is missing."""
    missing = np.isnan(x)
    b = np.floor((np.where(missing, lo, x) - lo) * ((bins - 1) / (hi - lo + 1e-8)))
    return np.where(missing, bins - 1, np.clip(b, 0, bins - 2)).astype(np.uint8)


def coded_table(rows: DataFrame, r: Round) -> DataFrame:
    """The training table (STATE) from x, y, w, valid, number and score: bins are found once for all rounds."""
    d, own = len(r.lo), r.numeric
    lo, hi, bins = r.lo[own], r.hi[own], r.p["bins"]
    names = [c.split()[0] for c in STATE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = bin_codes(matrix(batch.column("x"), d)[:, own], lo, hi, bins)
            edge = pa.py_buffer((np.arange(len(batch) + 1) * len(own)).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), len(batch), [None, edge, pa.py_buffer(np.ascontiguousarray(code))])
            yield pa.record_batch([column if c == "code" else batch.column(c) for c in names], names)

    return rows.mapInArrow(work, STATE)


# --- what a round knows before it grows ---------------------------------------------------------------


@dataclass
class Sample:
    """Training rows that the driver holds; `share` of the table."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    number: np.ndarray
    score: np.ndarray

    def graded(self, r: Round) -> tuple[np.ndarray, np.ndarray]:
        if r.kind == "given":
            return self.score[:, : r.k], self.score[:, r.k :]
        return gradients_of(r.kind, self.score, self.y, self.w, r.p["delta"])


def draw(state: DataFrame, r: Round, rows: int, stream: int) -> Sample:
    """About sampleRows training rows by a hash of their number, or all; bounded by SAMPLE_BYTES.  Scores have the pending trees in."""
    d, s = len(r.lo), r.k if r.kind != "given" else 2 * r.k
    width = d + s + 3
    share = min(r.p["sample_rows"], SAMPLE_BYTES // (8 * width)) / max(1, rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy(zero_copy_only=False)
            here = np.flatnonzero(~batch.column("valid").to_numpy(zero_copy_only=False) & (uniform(number, stream) < share))
            batch = batch.take(pa.array(here))
            x, score = matrix(batch.column("x"), d), matrix(batch.column("score"), s)
            score = score if r.kind == "given" else r.scored(x, score)
            parts = [x, *(batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("y", "w")), number[here, None].view(float), score]
            yield pa.record_batch([pa.array([np.ascontiguousarray(np.concatenate(parts, 1)).tobytes()], pa.binary())], ["rows"])

    blobs = state.mapInArrow(work, "rows binary").toArrow()["rows"].to_pylist()
    t = np.concatenate([np.frombuffer(b).reshape(-1, width) for b in blobs]) if blobs else np.zeros((0, width))
    t = t[np.argsort(t[:, d + 2].view(np.int64), kind="stable")]
    return Sample(t[:, :d], t[:, d], t[:, d + 1], np.ascontiguousarray(t[:, d + 2]).view(np.int64), t[:, d + 3 :])


def surveyed(state: DataFrame, r: Round) -> tuple[dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], dict | None]:
    """One job: gradient sums by (categorical feature, id), and the validation rows' mean loss and share of right classes."""
    k, d = r.k, len(r.lo)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {f: np.zeros((card + 1, 2 * k)) for f, card in r.cats.items()}
        loss, right, n = 0.0, 0, 0
        for batch in batches:
            if sums:
                x, _, g, h, _ = r.graded(batch)
                for f, total in sums.items():
                    ids = np.where(np.isnan(x[:, f]), len(total) - 1, x[:, f]).astype(np.int64)
                    np.add.at(total, ids, np.concatenate([g, h], 1))
            valid = batch.column("valid").to_numpy(zero_copy_only=False)
            if valid.any() and r.kind != "given":
                x, y = matrix(batch.column("x"), d)[valid], batch.column("y").to_numpy(zero_copy_only=False)[valid]
                score = r.scored(x, matrix(batch.column("score"), k)[valid])
                loss, n = loss + float(loss_of(r.kind, score, y, r.p["delta"]).sum()), n + int(valid.sum())
                right += int((score.argmax(1) == y).sum()) if r.kind == "softmax" else 0
        ids = [(f, c, row) for f, total in sums.items() for c, row in enumerate(total) if row.any()]
        if n:
            ids.append((-1, 0, np.array([loss, right, n])))
        yield pa.record_batch([pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int64()), pa.array([i[2].tolist() for i in ids], pa.list_(pa.float64()))], ["kind", "id", "sums"])

    found = state.mapInArrow(work, "kind long, id long, sums array<double>")
    width = max(3, 2 * k)
    by_id, metrics = {}, None
    for row in found.groupBy("kind", "id").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect():  # a row per category
        s = np.array([row[f"s{i}"] or 0.0 for i in range(width)])
        if row["kind"] < 0:
            metrics = {"loss": float(s[0] / s[2]), "accuracy": float(s[1] / s[2]) if r.kind == "softmax" else None}
        else:
            by_id[row["kind"], row["id"]] = s[:k], s[k : 2 * k]
    return by_id, metrics


def category_ranks(by_id: dict, f: int, card: int, kdom: int, lam: float) -> list[float]:
    """Ranks 0.. of the ids 0..card (the last one is missing or unseen) by (score, id)."""
    scores = [(g[kdom] / (h[kdom] + lam + 1e-8) if (f, c) in by_id else 0.0) for c in range(card + 1) for g, h in [by_id.get((f, c), (None, None))]]
    out = [0.0] * (card + 1)
    for rank, c in enumerate(sorted(range(card + 1), key=lambda c: (scores[c], c))):
        out[c] = float(rank)
    return out


def one_side_cut(state: DataFrame, r: Round, rows: int, sample: Sample, g: np.ndarray) -> tuple[int, int, int] | None:
    """Exact one-side sampling: the int(a n) rows of largest mean |g| (ties by hash), and int(b (n - top)) of the others by another hash.

    The sample says between which keys the cut lies; one job counts the rows
    above and brings the few between.  Where those would be too many, a sample
    of them narrows the window first.
    """
    a, b = r.p["goss"]
    top = int(a * rows)
    rest = int(b * (rows - top))
    if not top or not rest:
        return None
    size, tie, other = r.keys(g, sample.number)
    if len(sample.number) >= rows:
        order = np.lexsort((-tie, -size))
        left = order[top:]
        return int(size[order[top - 1]]), int(tie[order[top - 1]]), int(np.sort(other[left])[rest - 1]) + 1
    whole = float(2**63)
    known, place, of = np.stack([size, tie], 1), top / rows * len(size), len(size)
    window_rows, slack = float(rows), 6.0
    least, most = (-1, -1), (2**63 - 1, 2**63 - 1)
    while True:
        order = np.lexsort((-known[:, 1], -known[:, 0]))
        wide = slack * math.sqrt(max(1.0, place * (1 - place / max(1, of)))) + 2
        i, j = int(place - wide), int(place + wide) + 1
        high = tuple(int(v) for v in known[order[i]]) if i >= 0 else most
        low = tuple(int(v) for v in known[order[j]]) if j < len(order) else least
        expected = window_rows * min(1.0, (j - i) / max(1, of))
        keep = min(1.0, MOST_ORDERED / max(1.0, expected))
        share = rest / (rows - top)
        near = slack * math.sqrt(share * (1 - share) / (rows - top)) + 2.0 / (rows - top)
        from_, to = int(max(0.0, share - near) * whole), int(min(1.0, share + near) * whole)

        def work(batches: Iterator[pa.RecordBatch], low=low, high=high, keep=keep, from_=from_, to=to) -> Iterator[pa.RecordBatch]:
            above = under = 0
            for batch in batches:
                _, _, g, _, number = r.graded(batch)
                size, tie, other = r.keys(g, number)
                over = (size > high[0]) | ((size == high[0]) & (tie > high[1]))
                inside = ~over & ((size > low[0]) | ((size == low[0]) & (tie >= low[1])))
                above += int(over.sum())
                below = other[~over & ~inside]
                under += int((below < from_).sum())
                near = below[(below >= from_) & (below < to)]
                if keep < 1:
                    inside &= uniform(number, 3 * r.stream + 7) < keep
                yield pa.record_batch([pa.array([0]), pa.array([0]), pa.array([np.stack([size[inside], tie[inside], other[inside]], 1).tobytes()], pa.binary()), pa.array([near.tobytes()], pa.binary())], ["above", "under", "inside", "near"])
            yield pa.record_batch([pa.array([above]), pa.array([under]), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], ["above", "under", "inside", "near"])

        got = state.mapInArrow(work, "above long, under long, inside binary, near binary").toArrow()
        above, under = (int(sum(got[c].to_pylist())) for c in ("above", "under"))
        keys = np.frombuffer(b"".join(got["inside"].to_pylist()), np.int64).reshape(-1, 3)
        if keep < 1:  # a sample of the window stands for it
            window_rows, of = len(keys) / keep, len(keys)
            known, place = keys[:, :2], (top - above) * keep
            least, most = low, high
            continue
        need = top - above
        if 1 <= need <= len(keys):
            order = np.lexsort((-keys[:, 1], -keys[:, 0]))
            left = np.sort(np.concatenate([keys[order[need:], 2], np.frombuffer(b"".join(got["near"].to_pylist()), np.int64)]))
            # Of the rows below the window only hashes from `from_` to `to` were brought.
            first = int(np.searchsorted(left, from_))
            k = rest - under - 1  # place of the last one drawn, among all that are here
            if first <= k < int(np.searchsorted(left, to)):
                return int(keys[order[need - 1], 0]), int(keys[order[need - 1], 1]), int(left[k]) + 1
        slack *= 4
        known, place, of, window_rows, least, most = np.stack([size, tie], 1), top / rows * len(size), len(size), float(rows), (-1, -1), (2**63 - 1, 2**63 - 1)


# --- the search for splits -------------------------------------------------------------------------------


def scan(cells: np.ndarray, k: int, p: dict, missing: bool) -> tuple | None:
    """The best cut of one histogram (bins x [G, H, n]): bin, nan_left, gain, rows left and right, left sums, whole sums.

    With `missing` the last bin is missing values, tried on both sides.  Cuts
    are after bins that have rows; ties go to the lowest bin, then missing left.
    """
    walked, gone = (cells[:-1], cells[-1]) if missing else (cells, np.zeros(cells.shape[1]))
    at = np.flatnonzero(walked[:, -1] > 0)
    if not len(at):
        return None
    run, total = walked.cumsum(0)[at], cells.sum(0)

    def score(s: np.ndarray) -> np.ndarray:
        g = np.sign(s[..., :k]) * np.maximum(np.abs(s[..., :k]) - p["alpha"], 0) if p["alpha"] else s[..., :k]
        return (g * g / (s[..., k : 2 * k] + p["lam"] + 1e-8)).sum(-1)

    best = None
    for nan_left in (1, 0) if gone[-1] > 0 else (1,):
        left = run + nan_left * gone
        right = total - left
        fair = (left[:, -1] >= p["min_rows"]) & (right[:, -1] >= p["min_rows"]) & (left[:, k : 2 * k].sum(1) >= p["min_weight"]) & (right[:, k : 2 * k].sum(1) >= p["min_weight"])
        if not fair.any():
            continue
        gain = np.where(fair, 0.5 * (score(left) + score(right) - score(total)), -np.inf)
        b = int(gain.argmax())
        found = (int(at[b]), nan_left, float(gain[b]), int(round(left[b, -1])), int(round(right[b, -1])), left[b, :-1], total[:-1])
        if best is None or (found[2], -found[0]) > (best[2], -best[0]):
            best = found
    return best


@dataclass
class Target:
    """A node to search: `small` is the child whose rows are summed, `wanted` the children asked for; of the root, itself."""

    parent: int  # -1: the root
    small: int
    wanted: list[int]


@dataclass
class Projection:
    """A direction with a histogram of its own: values of w . x cut into `bins` equal widths of [lo, hi]; two bins around a threshold are one cut."""

    w: np.ndarray
    lo: float
    hi: float
    bins: int
    family: str

    def codes(self, x: np.ndarray, means: np.ndarray) -> np.ndarray:
        if self.bins == 2:
            return np.where(left_of(self.node(0), x, means), 0, 1)
        value = np.where(np.isnan(x), means, x) @ self.w
        return np.clip(np.floor((value - self.lo) * (self.bins / (self.hi - self.lo + 1e-8))), 0, self.bins - 1).astype(np.int64)

    def node(self, b: int) -> Node:
        threshold = self.lo if self.bins == 2 else self.lo + (b + 1) * (self.hi - self.lo + 1e-8) / self.bins
        return Node(0, [], self.w.tolist(), float(threshold), True, 0.0, self.family)


def search(state: DataFrame, r: Round, tree: Tree, view: dict[int, Node], targets: list[Target], kept: dict[int, DataFrame | dict], projections: dict[int, list[Projection]]) -> tuple[DataFrame | dict, dict[int, dict[int, dict]]]:
    """One job: the best cut of every wanted node and feature; features D and up are the node's projections.

    Returns the table with the nodes' sums, to be kept for their children, and
    per node its best cut by feature (all features, or the best one where there
    are many).
    """
    k, d, bins, p = r.k, len(r.lo), r.p["bins"], r.p
    means = r.scales(tree)[0]
    width = 2 * k + 1
    wanted = {t.small: t for t in targets}
    smalls = np.array([t.small for t in targets])
    order_of = np.argsort(smalls)
    active = np.flatnonzero(r.active)

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((width, len(targets) * len(active) * bins))
        own = {(t, e): np.zeros((proj.bins, width)) for t, all_ in projections.items() for e, proj in enumerate(all_)}
        for batch in batches:
            x, codes, sums, _ = r.used(batch, tree)
            node = route(view, x, means)
            j = order_of[np.minimum(np.searchsorted(smalls[order_of], node), len(smalls) - 1)]
            here = np.flatnonzero(smalls[j] == node)
            if len(here) and len(active):
                place = ((j[here, None] * len(active) + np.arange(len(active))) * bins + codes[here][:, active]).ravel()
                for c in range(width):
                    cells[c] += np.bincount(place, np.repeat(sums[here, c], len(active)), cells.shape[1])
            for t, all_ in projections.items():
                rows = np.flatnonzero(node == t)
                for e, proj in enumerate(all_) if len(rows) else ():
                    code = proj.codes(x[rows], means)
                    for c in range(width):
                        own[t, e][:, c] += np.bincount(code, sums[rows, c], proj.bins)
        stacked = cells.reshape(width, len(targets), len(active), bins)
        rows = [(t.small, int(f), np.ascontiguousarray(stacked[:, j, n].T)) for j, t in enumerate(targets) for n, f in enumerate(active)]
        rows += [(t, d + e, c) for (t, e), c in own.items()]
        rows = [row for row in rows if row[2][:, -1].any()]
        yield pa.record_batch([pa.array([row[0] for row in rows], pa.int64()), pa.array([row[1] for row in rows], pa.int32()), pa.array([False] * len(rows)), pa.array([row[2].tobytes() for row in rows], pa.binary())], ["node", "f", "above", "cells"])

    partial = state.mapInArrow(sums_of, "node long, f int, above boolean, cells binary")

    def settled(t: int, f: int, total: np.ndarray | None, above: np.ndarray | None) -> Iterator[tuple]:
        """Rows of FOUND from the sums of node t and, for its sibling, of their parent."""
        if f >= d:
            sums = [(t, total)]
        else:
            own, sums = total if total is not None else np.zeros((bins, width)), []
            for node in wanted[t].wanted:
                if node == t:
                    sums.append((node, own))
                elif above is not None:
                    rest = above - own
                    rest[np.rint(rest[:, -1]) <= 0] = 0.0
                    sums.append((node, rest))
        for node, cells in sums:
            best = scan(cells, k, p, f < d)
            b, nan_left, gain, n_left, n_right, left, whole = best if best else (-1, 0, -math.inf, 0, 0, np.zeros(2 * k), cells.sum(0)[:-1])
            yield node, f, b, nan_left, gain, n_left, n_right, left.tolist(), whole.tolist(), cells if f < d else None

    names = [c.split()[0] for c in FOUND.split(", ")]
    found: dict[int, dict[int, dict]] = {}
    if r.local:  # few tasks and small sums: the driver adds them
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in partial.drop("above").toArrow().to_batches():
            for t, f, c in zip(*(batch.column(c).to_pylist() for c in ("node", "f", "cells"))):
                cells = np.frombuffer(c).reshape(-1, width)
                total[t, f] = total[t, f] + cells if (t, f) in total else cells
        table: dict[tuple[int, int], np.ndarray] = {}
        for t, f in sorted({*total, *((t.small, int(f)) for t in targets for f in active)}):
            above = kept[wanted[t].parent].get((wanted[t].parent, f)) if f < d and wanted[t].parent >= 0 else None
            for row in settled(t, f, total.get((t, f)), above):
                found.setdefault(row[0], {})[f] = dict(zip(names[:-1], row))
                if f < d:
                    table[row[0], f] = row[-1]
        return table, found
    for above in {id(kept[t.parent]): kept[t.parent] for t in targets if t.parent >= 0}.values():
        # The parent's sums travel under the name of the child that is summed.
        small = {t.parent: t.small for t in targets if t.parent >= 0 and kept[t.parent] is above}
        name = F.element_at(F.create_map(*[F.lit(v) for pair in small.items() for v in pair]), F.col("node"))
        partial = partial.union(above.where(F.col("node").isin(list(small)) & (F.col("f") < d)).select(name.cast("long"), "f", F.lit(True), "cells"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, above = None, None, None

        def rows() -> pa.RecordBatch:
            lines = [(*row[:-1], row[-1].tobytes() if row[-1] is not None else b"") for row in settled(*key, total, above)]
            columns = list(zip(*lines)) or [()] * len(names)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]
            return pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["node"], row["f"]) != key:
                    if key is not None:
                        yield rows()
                    key, total, above = (row["node"], row["f"]), None, None
                c = np.frombuffer(row["cells"]).reshape(-1, width)
                if row["above"]:
                    above = c
                else:
                    total = c if total is None else total + c
        if key is not None:
            yield rows()

    table = partial.repartition("node", "f").sortWithinPartitions("node", "f").mapInArrow(gathered, FOUND).persist()
    light = table.drop("cells")
    if sum(len(t.wanted) for t in targets) * d > MOST_COMPARED:
        order = F.struct("gain", -F.col("f"), -F.col("bin"), "nan_left")
        light = light.where("gain > 0").groupBy("node").agg(F.max_by(F.struct(*light.columns), order).alias("b")).select("b.*")
    for row in light.collect():
        found.setdefault(row["node"], {})[row["f"]] = row.asDict()
    return table, found


@dataclass
class Moments:
    """Sums over all rows of a node: z'g and z'Hz on `on`, for the class of most gradient."""

    on: np.ndarray
    xg: np.ndarray
    gram: np.ndarray


def moments(state: DataFrame, r: Round, tree: Tree, view: dict[int, Node], nodes: list[int], support: dict[int, np.ndarray], k_of: dict[int, int]) -> dict[int, Moments]:
    """One job: the normal equations of each node over all its rows, on its supporting features, scaled, missing as the mean."""
    k = r.k
    centre, width = r.scales(tree)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {t: np.zeros((len(support[t]), len(support[t]) + 1)) for t in nodes}
        for batch in batches:
            x, _, sums, _ = r.used(batch, tree)
            node = route(view, x, centre)
            for t in nodes:
                rows = np.flatnonzero(node == t)
                if len(rows):
                    on = support[t]
                    z = (x[np.ix_(rows, on)] - centre[on]) / width[on]
                    z = np.where(np.isnan(z), 0.0, z)
                    g, h = sums[rows, k_of[t]], sums[rows, k + k_of[t]]
                    held[t] += np.concatenate([(z.T * h) @ z, (z.T @ g)[:, None]], 1)
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([held[t].ravel().tolist() for t in nodes], pa.list_(pa.float64()))], ["node", "m"])

    cells = state.mapInArrow(work, "node long, m array<double>").select("node", F.posexplode("m")).groupBy("node", "pos").agg(F.sum("col").alias("v"))
    flat: dict[int, np.ndarray] = {t: np.zeros(len(support[t]) * (len(support[t]) + 1)) for t in nodes}
    for row in cells.collect():  # MOST_SOLVED squared a node
        flat[row["node"]][row["pos"]] = row["v"]
    out = {}
    for t in nodes:
        m = flat[t].reshape(len(support[t]), -1)
        out[t] = Moments(support[t], m[:, -1], m[:, :-1])
    return out


def resampled(state: DataFrame, r: Round, tree: Tree, view: dict[int, Node], sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """One job: about nodeSample rows ([x, g, h]) of each of some nodes, by a hash of their number; bounded by SAMPLE_BYTES."""
    d, k = len(r.lo), r.k
    means = r.scales(tree)[0]
    each = min(r.p["node_sample"], SAMPLE_BYTES // (8 * (d + 2 * k) * len(sizes)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, sums, number = r.used(batch, tree)
            node, u = route(view, x, means), uniform(number, 3 * r.stream + 11)
            nodes, blobs = [], []
            for t, n in sizes.items():
                rows = np.flatnonzero((node == t) & (u * n < each))
                if len(rows):
                    nodes.append(t)
                    blobs.append(np.ascontiguousarray(np.concatenate([x[rows], sums[rows, : 2 * k], u[rows, None]], 1)).tobytes())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["node", "rows"])

    parts: dict[int, list[np.ndarray]] = {t: [np.zeros((0, d + 2 * k + 1))] for t in sizes}
    for row in state.mapInArrow(work, "node long, rows binary").toArrow().to_pylist():
        parts[row["node"]].append(np.frombuffer(row["rows"]).reshape(-1, d + 2 * k + 1))
    whole = {t: np.concatenate(p) for t, p in parts.items()}
    return {t: p[np.argsort(p[:, -1], kind="stable"), :-1] for t, p in whole.items()}


@dataclass
class Log:
    """Gains of all candidates of each searched node: tree, node, depth, rows, family, gain."""

    rows: list[tuple] = field(default_factory=list)


def propose(r: Round, tree: Tree, rows: np.ndarray, t: int, parent: np.ndarray | None, cache: directions.Cache, mask: np.ndarray, rng: np.random.Generator, log: list | None = None) -> Projection | None:
    """The best oblique split of node t on its sample rows ([x, g, h]), in the units of the features."""
    k, d, p = r.k, len(r.lo), r.p
    active = r.active & mask
    if not p["directions"] or len(rows) < LEAST_OBLIQUE or active.sum() < 2:
        return None
    x, g, h = rows[:, :d], rows[:, d : d + k], rows[:, d + k : d + 2 * k]
    centre, width = r.scales(tree)
    z = np.where(np.isnan(x), 0.0, (x - centre) / width)
    kdom = int(np.abs(g).sum(0).argmax())
    xg = z.T @ g[:, kdom]
    sis = np.abs(xg) / np.sqrt((h[:, kdom, None] * z * z).sum(0) + p["lam"] + 1e-8)
    depth = int(math.log2(t + 1))
    budget = p["directions"] if depth <= 2 else min(p["directions"], 8)
    made = directions.candidates(sis, xg, active, parent, cache, depth, budget, p, rng)
    if not made:
        return None
    tried = np.array([w for w, _ in made])
    projected = z @ tried.T
    lo, hi = projected.min(0), projected.max(0)
    code = np.minimum(OBLIQUE_BINS - 1, ((projected - lo) / (hi - lo + 1e-8) * OBLIQUE_BINS).astype(np.int64)) + OBLIQUE_BINS * np.arange(len(tried))

    def hist(weights: np.ndarray) -> np.ndarray:
        whole = np.bincount(code.ravel(), np.repeat(weights, len(tried)), OBLIQUE_BINS * len(tried))
        return whole.reshape(len(tried), OBLIQUE_BINS).cumsum(1)

    gain = 0.0
    for i in range(k):
        gl, hl = hist(g[:, i]), hist(h[:, i])
        for sign, gs, hs in ((1, gl, hl), (1, gl[:, -1:] - gl, hl[:, -1:] - hl), (-1, gl[:, -1:], hl[:, -1:])):
            thresholded = np.sign(gs) * np.maximum(np.abs(gs) - p["alpha"], 0)
            gain = gain + sign * 0.5 * thresholded**2 / (hs + p["lam"] + 1e-8)
    n = hist(np.ones(len(rows)))
    gain = np.where((n > 0) & (n < len(rows)), gain, -np.inf)
    if log is not None:
        log += [(family, float(v)) for (_, family), v in zip(made, gain.max(1)) if math.isfinite(v)]
    best, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[best, b] > 0:
        return None
    threshold = lo[best] + (b + 1) * (hi[best] - lo[best] + 1e-8) / OBLIQUE_BINS + float(tried[best] @ (centre / width))
    # Missing values count as the mean, also of ranks: those are never missing.
    return Projection(tried[best] / width, float(threshold), float(threshold), 2, "oblique")


def solved(r: Round, tree: Tree, m: Moments, mask: np.ndarray) -> list[Projection]:
    """The directions asked for (covariance, wls) from a node's sums, with bins over the range that the features allow."""
    centre, width = r.scales(tree)
    on = m.on[mask[m.on]]
    keep = np.isin(m.on, on)
    if keep.sum() < 2:
        return []
    out = []
    for name in r.p["exact"]:
        w = np.zeros(len(r.lo))
        w[on] = directions.covariance(m.xg[keep], np.ones(keep.sum(), bool)) if name == "covariance" else directions.wls(m.gram[np.ix_(keep, keep)], m.xg[keep], r.p["lam"])
        if np.count_nonzero(w) < 2 or not np.isfinite(w).all():
            continue
        w = w / width
        least = np.where(np.isin(np.arange(len(w)), list(r.cats)), 0.0, r.lo)
        most = np.where(np.isin(np.arange(len(w)), list(r.cats)), centre * 2, r.hi)
        out.append(Projection(w, float(np.minimum(w * least, w * most).sum()), float(np.maximum(w * least, w * most).sum()), r.p["bins"] - 1, name))
    return out


def picked(state: DataFrame, r: Round) -> tuple[DataFrame, Round]:
    """The rows that the round uses, with their gradients (factors included) in the place of scores, and the round for them.

    Where few rows are used, every further job reads only these and grades none again.
    """
    names, k = [c.split()[0] for c in STATE.split(", ")], r.k

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~batch.column("valid").to_numpy(zero_copy_only=False)))
            _, _, g, h, number = r.graded(batch)
            keep, factor = r.chosen(g, h, number)
            at, sums = np.flatnonzero(keep), np.concatenate([g[keep], h[keep]], 1) * factor[keep, None]
            batch = batch.take(pa.array(at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * 2 * k + 1, 2 * k), pa.int32()), pa.array(sums.ravel()))
            yield pa.record_batch([lists if c == "score" else batch.column(c) for c in names], names)

    own = copy.copy(r)
    own.kind, own.cut, own.pending, own.p = "given", None, [], r.p | {"goss": None, "subsample": 1.0}
    return state.mapInArrow(work, STATE).persist(), own


def grow(state: DataFrame, r: Round, rows: int, sample: Sample, rng: np.random.Generator, cache: directions.Cache, by_id: dict, log: Log | None = None) -> Tree:
    """One tree, always splitting the searched node of largest gain, up to the leaf budget."""
    k, p, d = r.k, r.p, len(r.lo)
    g, h = sample.graded(r)
    if p["goss"]:
        r.cut = one_side_cut(state, r, rows, sample, g)
    used, factor = r.chosen(g, h, sample.number)
    own = np.concatenate([sample.x[used], g[used] * factor[used, None], h[used] * factor[used, None]], 1)
    tree = Tree({0: Node(0, [0.0] * k)})
    if r.cats:
        kdom = int(np.abs(own[:, d : d + k]).sum(0).argmax()) if len(own) else 0
        tree.ranks = {f: category_ranks(by_id, f, card, kdom, p["lam"]) for f, card in r.cats.items()}
        own[:, :d] = ranked(own[:, :d], tree)
    means, width = r.scales(tree)
    n_mask = max(1, int(np.rint(d * p["colsample"])))
    numeric = np.isin(np.arange(d), r.numeric)
    r.local = r.parts * d * p["bins"] * (2 * k + 1) * 8 <= MOST_LOCAL
    per_job = max(1, MOST_CELLS // max(1, d * p["bins"] * (2 * k + 1)))
    samples: dict[int, np.ndarray] = {0: own}
    parents: dict[int, np.ndarray | None] = {0: None}
    sizes: dict[int, int] = {}
    best: dict[int, tuple[dict, Node]] = {}  # searched nodes: their sums, and the split if there is a good one
    kept: dict[int, DataFrame | dict] = {}
    tables: list[DataFrame | dict] = []
    splits_: dict[int, Node] = {}
    seen: set[int] = set()

    def mask_of(t: int) -> np.ndarray:
        mask = np.zeros(d, bool)
        mask[np.random.default_rng((p["seed"], r.stream, t)).permutation(d)[:n_mask]] = True
        return mask

    def leaf(sums: list[float], parent: list[float] | None) -> list[float]:
        out = []
        for i in range(k):
            raw = -math.copysign(max(abs(sums[i]) - p["alpha"], 0.0), sums[i]) / (sums[k + i] + p["lam"] + 1e-8)
            out.append(raw if parent is None or not p["smooth"] else (sums[k + i] * raw + p["lam"] * parent[i]) / (sums[k + i] + p["lam"] + 1e-8))
        return out

    def view_with(expanded: list[int]) -> dict[int, Node]:
        view = dict(tree.nodes)
        for t in expanded:
            view[t] = splits_[t]
            for c in (2 * t + 1, 2 * t + 2):
                view.setdefault(c, Node(c, [0.0] * k))
        return view

    def look(targets: list[Target]) -> None:
        """Search the targets' wanted nodes."""
        view = view_with([t.parent for t in targets if t.parent >= 0])
        nodes = [n for t in targets for n in t.wanted]
        for t in targets:
            if t.parent >= 0:
                side = left_of(splits_[t.parent], samples[t.parent][:, :d], means)
                for n in t.wanted:
                    samples[n] = samples[t.parent][side if n % 2 else ~side]
        if p["directions"]:
            thin = {n: sizes[n] for n in nodes if n in sizes and len(samples[n]) < min(ENOUGH, sizes[n]) and sizes[n] >= LEAST_OBLIQUE}
            if thin:
                samples.update(resampled(state, r, tree, view, thin))
        projections, candidates = {}, {}
        for n in nodes:
            candidates[n] = []
            one = propose(r, tree, samples[n], n, parents[n], cache, mask_of(n), rng, candidates[n] if log is not None else None)
            projections[n] = [one] if one else []
        if p["exact"]:
            support, k_of = {}, {}
            for n in nodes:
                x, gs, hs = samples[n][:, :d], samples[n][:, d : d + k], samples[n][:, d + k :]
                k_of[n] = int(np.abs(gs).sum(0).argmax()) if len(gs) else 0
                z = np.where(np.isnan(x), 0.0, (x - means) / width)
                sis = np.abs(z.T @ gs[:, k_of[n]]) / np.sqrt((hs[:, k_of[n], None] * z * z).sum(0) + p["lam"] + 1e-8)
                on = np.flatnonzero(r.active)
                support[n] = np.sort(on[np.argsort(-sis[on], kind="stable")[:MOST_SOLVED]])
            for n, m in moments(state, r, tree, view, nodes, support, k_of).items():
                projections[n] += solved(r, tree, m, mask_of(n))
        table, found = search(state, r, tree, view, targets, kept, projections)
        tables.append(table)
        for n in nodes:
            kept[n] = table
            cuts = found.get(n, {})
            mask = mask_of(n)
            fair = [c for f, c in cuts.items() if c["gain"] > -math.inf and (f >= d or mask[f])]
            any_ = next(iter(cuts.values()), None)
            top = max(fair, key=lambda c: (c["gain"], -c["f"], -c["bin"], c["nan_left"]), default=None)
            node = None
            if top is not None and top["gain"] > p["gamma"]:
                if top["f"] >= d:
                    node = projections[n][top["f"] - d].node(top["bin"])
                else:
                    w = [0.0] * d
                    w[top["f"]] = 1.0
                    node = Node(n, [], w, r.edge(top["f"], top["bin"], tree), bool(top["nan_left"]), 0.0, "axis")
                node.id, node.gain = n, top["gain"]
            best[n] = (top or any_, node)
            if log is not None:
                depth, size = int(math.log2(n + 1)), sizes.get(n, rows)
                log.rows += [(r.stream, n, depth, size, "axis", float(c["gain"])) for f, c in cuts.items() if f < d and c["gain"] > -math.inf]
                log.rows += [(r.stream, n, depth, size, family, v) for family, v in candidates[n]]
                log.rows += [(r.stream, n, depth, size, pr.family, float(cuts[d + e]["gain"])) for e, pr in enumerate(projections[n]) if pr.bins > 2 and d + e in cuts]

    def expanded(t: int) -> Target | None:
        """The search for the children of a node whose split is known; None if neither is worth one."""
        cut, node = best[t]
        splits_[t] = node
        n = {2 * t + 1: cut["n_left"], 2 * t + 2: cut["n_right"]}
        sizes.update(n)
        for c in n:
            parents[c] = directions.unit(np.array(node.w) * width)
        wanted = [c for c, size in n.items() if size >= 2 * max(1, p["min_rows"]) and int(math.log2(c + 1)) < p["deepest"]]
        return Target(t, min(n, key=lambda c: (n[c], c)), wanted) if wanted else None

    few = r.cut is not None
    if few:
        state, r = picked(state, r)
    look([Target(-1, 0, [0])])
    cut, node = best[0]
    tree.nodes[0].leaf = leaf(cut["total_sums"], None) if cut else root_leaf(state, r, leaf)
    leaves = 1
    heap = [(-node.gain, 0)] if node else []
    while heap and leaves < p["leaves"]:
        _, t = heapq.heappop(heap)
        cut, node = best[t]
        last = leaves + 1 == p["leaves"]
        if t not in seen and not last:
            # Children of this node, and of those that may follow, in one job.
            ahead = [t] + [n for _, n in heapq.nsmallest(min(AHEAD, per_job, p["leaves"] - leaves - 1) - 1, heap) if n not in seen]
            seen.update(ahead)
            targets = [x for x in map(expanded, ahead) if x]
            for c in range(0, len(targets), per_job):
                look(targets[c : c + per_job])
        node.leaf = tree.nodes[t].leaf
        tree.nodes[t] = node
        leaves += 1
        if node.family == "oblique" and not np.any(np.array(node.w)[~numeric]):
            cache.add(np.array(node.w) * width)
        for side, child in enumerate((2 * t + 1, 2 * t + 2)):
            sums = cut["left_sums"] if side == 0 else [a - b for a, b in zip(cut["total_sums"], cut["left_sums"])]
            tree.nodes[child] = Node(child, leaf(sums, node.leaf))
            if not last and child in best and best[child][1]:
                heapq.heappush(heap, (-best[child][1].gain, child))
    if few:
        state.unpersist()
    for table in tables:
        if not r.local:
            table.unpersist()
    return tree


def root_leaf(state: DataFrame, r: Round, leaf: Callable) -> list[float]:
    """The root's value where no feature has rows to sum."""
    k = r.k

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * k)
        for batch in batches:
            _, _, g, h, number = r.graded(batch)
            used, factor = r.chosen(g, h, number)
            total += np.concatenate([g[used] * factor[used, None], h[used] * factor[used, None]], 1).sum(0)
        yield pa.record_batch([pa.array([total[i]]) for i in range(2 * k)], [f"s{i}" for i in range(2 * k)])

    row = state.mapInArrow(work, ", ".join(f"s{i} double" for i in range(2 * k))).agg(*[F.sum(f"s{i}") for i in range(2 * k)]).first()
    return leaf([float(v or 0.0) for v in row], None)
