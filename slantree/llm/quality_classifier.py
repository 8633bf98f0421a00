"""Quality classifier by positive-unlabelled learning.

A linear model over ramp-expanded text statistics minimises the non-negative
unbiased PU risk

    pi * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - pi * E_pos[loss(-g)])

with trusted positives (rows labelled 1), unlabelled web text (any row of the
training fold) and a class prior pi estimated from these two alone
(`estimate_prior`); rows labelled 0 are used as unlabelled ones only.  With the
logistic loss, the sigmoid of g estimates P(label = 1).

Fitting uses bounded, documented samples (`MAX_ROWS` positives and as many
unlabelled rows, chosen by a hash of doc_id); scoring covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from slantree.llm.durable import short_batches
from slantree.llm.quality_rules import MEASURES, _measured
from slantree.llm.text_arrays import SPACE, TextBatch, pieces

#: Bound on the rows of each training sample.
MAX_ROWS = 20_000
#: Ramps rise between zero and at these quantiles of a statistic's non-zero values, so that rare signs get their own ramps.
QUANTILES = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?\"'()-"]] = True
FEATURES = ("symbols", "dup_lines", "repeats", "upper", "word_length", "log_words", "digits", "punctuation", "new_words", "words_per_line", "wide_bytes", "stutter")


def _features(texts: pa.Array) -> np.ndarray:
    """Rates that do not depend on a text's length alone; an empty text has zeros."""
    m = {k: c.to_numpy() for k, c in zip(MEASURES, _measured(texts).flatten())}
    x = TextBatch(texts)
    start, end, doc = x.words()
    hashes = x.hashes(start, end)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    words = np.maximum(1, m["n_words"])
    size = np.maximum(1, x.end - x.start)
    twice = (doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])
    columns = {
        "stutter": np.bincount(doc[1:][twice], minlength=x.n) / words,
        "symbols": m["n_symbols"] / words,
        "dup_lines": m["n_dup_lines"] / np.maximum(1, m["n_lines"]),
        "repeats": m["n_repeat_words"] / words,
        "upper": m["n_upper"] / np.maximum(1, m["n_letters_ascii"]),
        "word_length": m["word_chars"] / words,
        "log_words": np.log1p(m["n_words"]),
        "digits": x.per_doc(_DIGIT[x.bytes]) / size,
        "punctuation": x.per_doc(_PUNCTUATION[x.bytes]) / words,
        "new_words": np.bincount(doc[order][new], minlength=x.n) / words,
        "words_per_line": np.log1p(m["n_words"] / np.maximum(1, m["n_lines"])),
        "wide_bytes": x.per_doc((x.bytes >= 0x80) & ~SPACE[x.bytes]) / size,
    }
    rates = ("symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "wide_bytes", "stutter")
    return np.stack([np.log1p(20 * columns[f]) if f in rates else columns[f] for f in FEATURES], 1).astype(np.float32)


@F.arrow_udf(ArrayType(FloatType()))
def features(texts: pa.Array) -> pa.Array:
    """The statistics of FEATURES of each text, as an array column."""
    got = np.concatenate([_features(p) for p in pieces(texts)])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]), pa.array(got.ravel()))


@dataclass
class Model:
    knots: np.ndarray  # feature x ramp
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        ramps = np.clip((x[:, :, None] - self.knots[None]) / self.scale[None], 0.0, 1.0)
        return np.concatenate([ramps.reshape(len(x), -1), np.ones((len(x), 1))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.expand(x) @ self.weights, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimise the non-negative PU risk by Adam over full batches; deterministic.

    While the estimated risk on negatives is below zero, the step climbs it
    instead, as the non-negative estimator asks.
    """
    filled = [x[x != 0] if (x != 0).any() else x for x in unlabelled.T]
    knots = np.stack([np.append(0.0, np.quantile(x, QUANTILES)) for x in filled])
    top = np.array([np.quantile(x, 0.995) for x in filled])
    scale = np.maximum(0.02, np.diff(np.concatenate([knots, top[:, None]], 1), axis=1))
    model = Model(knots, scale, np.zeros(knots.size + 1), prior)
    p, u = model.expand(positive), model.expand(unlabelled)
    first, second = np.zeros_like(model.weights), np.zeros_like(model.weights)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    for step in range(1, steps + 1):
        gp, gu = p @ model.weights, u @ model.weights
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        slope_negative = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        slope_positive = prior * (p.T @ (sigmoid(gp) - 1)) / len(p)
        slope = slope_positive + slope_negative if negative >= 0 else -slope_negative
        slope = slope + decay * np.append(model.weights[:-1], 0.0)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        model.weights = model.weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 2, steps: int = 400, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled rows, from the best bin of a held-out ranking.

    Above any threshold of a score, the unlabelled share divided by the
    positives' share is at least the prior, and comes down to it where only
    positives score as high.  Each half of the rows is ranked by a model fitted
    to the other half, at a prior of 0.5 first and at the estimate so far in
    later rounds; the threshold is the one of the smallest upper confidence
    bound (level 1 - delta).  The halves' estimates are averaged and kept within
    0.05 and 0.95; with fewer than two positives or two unlabelled rows the
    answer is 0.5.  The order of the rows does not matter.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    halves = [(p[k::2], u[k::2]) for p, u in [(_ordered(positive), _ordered(unlabelled))] for k in (0, 1)]
    prior = 0.5
    for _ in range(rounds):
        found = []
        for fitted, (p, u) in zip(halves[::-1], halves):
            model = fit_nnpu(*fitted, prior=prior, steps=steps)
            p, u = np.sort(model.expand(p) @ model.weights), np.sort(model.expand(u) @ model.weights)
            # Thresholds at the positives' own scores, so that none is above all of them.
            share_p = 1 - np.searchsorted(p, p, "left") / len(p)
            share_u = 1 - np.searchsorted(u, p, "left") / len(u)
            slack = np.sqrt(np.log(4 / delta) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
            best = np.argmin((share_u + slack) / share_p)
            found.append(share_u[best] / share_p[best])
        prior = float(np.clip(np.mean(found), 0.05, 0.95))
    return prior


def _ordered(x: np.ndarray) -> np.ndarray:
    """The rows in an order of their values, whatever order they came in."""
    return x[np.lexsort(x.T[::-1])]


def _sample(ids: DataFrame, bound: int) -> DataFrame:
    """At most `bound` ids, those with the smallest hash: a threshold first, then a top-k."""
    n = ids.count()
    h = F.abs(F.xxhash64("doc_id", F.lit(17)).cast("double"))
    return ids.where(h <= 2.0**63 * min(1.0, 1.5 * bound / max(1, n))).withColumn("_h", h).orderBy("_h", "doc_id").limit(bound).select("doc_id")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on `docs` (doc_id, text) and `labels` (doc_id, quality); both must be the training fold already.

    A document with differing labels counts as not trusted, and of differing
    texts of one document the least is read.  Without positives or documents
    the model answers 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def gather(ids: DataFrame) -> np.ndarray:
        chosen = F.broadcast(_sample(ids, max_rows))  # at most max_rows ids
        rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        got = rows.select(features("text").alias("f")).toPandas()["f"]  # at most max_rows short arrays
        return _ordered(np.stack(got.to_list()).astype(float)) if len(got) else np.zeros((0, len(FEATURES)))

    positive = gather(known.where("quality = 1").select("doc_id"))
    unlabelled = gather(docs.where(F.col("doc_id").isNotNull()).select("doc_id"))
    if not len(positive) or not len(unlabelled):
        empty = np.zeros((len(FEATURES), len(QUANTILES) + 1))
        return Model(empty, np.ones_like(empty), np.zeros(empty.size + 1), 0.5)
    prior = estimate_prior(positive, unlabelled)
    return fit_nnpu(positive, unlabelled, prior)


def classify(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add `score` (double) and `predicted` (1 if score >= threshold) to each row.

    A null text counts as empty; equal texts get equal scores.
    """

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.score(_features(p).astype(float)) for p in pieces(texts)]))

    out = short_batches(df).withColumn("score", score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
