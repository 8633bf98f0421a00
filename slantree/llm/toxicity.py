"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Words are runs of letters, A-Z lower-cased (a byte of 128 or more counts as a
letter).  An input of the network is one word: what the training fold tells of
the word itself, and of its character n-grams (the strongest of each length and
their mean), each as a log-odds that is drawn towards zero by its standard
error.  For training, a document's inputs come from the other folds only
(FOLDS), so that the network learns what such evidence is worth on new texts.

Two gated recurrent units read a window of WINDOW words, one from either end;
attention pools their states and one unit scores the pooled state.  Every window
of a text is scored, at steps of STRIDE words, so each word stands in two; the
text's score follows from its worst window and from the mean of all.  Labels are of documents: in training
a toxic document is represented by its window of highest score, a clean one by
that and others.  Forward and backward passes are numpy; the bounded training
sample (MAX_DOCS distinct texts of either label, MAX_WINDOWS windows of each) is
fitted on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from slantree.llm.durable import short_batches
from slantree.llm.text_arrays import TextBatch, mix, pieces, slices

#: Bounds of the training sample: distinct texts of either label, windows of a text, bytes of a window.
MAX_DOCS, MAX_WINDOWS, MAX_BYTES = 1500, 24, 4096
WINDOW, STRIDE = 32, 16
#: Buckets of a table of words or n-grams (a power of two); lengths of n-grams, the word's two ends included.
BITS, ORDERS = 16, (3, 4, 5, 6)
FOLDS, EPOCHS, STEPS, BATCH, HIDDEN, ATTENTION = 4, 6, 500, 64, 8, 8
#: Weight decay.
DECAY = 1e-3
#: Windows that one matrix product scores, and windows whose words are described at a time.
BLOCK, TOGETHER = 1024, 4096
CHANNELS = 2 + len(ORDERS)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(x: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word of a lower-cased batch."""
    inside = _LETTER[x.bytes]
    edge = np.zeros(len(inside) + 1, bool)
    edge[x.start] = edge[x.end] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(opens)
    # Empty texts share a start with the next one; the last of them holds the word.
    return start, np.flatnonzero(closes) + 1, np.searchsorted(x.start, start, "right") - 1


def window_starts(n_words: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Document, and first word within it, of every window; the last window of a text reaches its end."""
    n = np.where(n_words > 0, 1 + np.maximum(0, -(-(n_words - WINDOW) // stride)), 0)
    doc = np.repeat(np.arange(len(n)), n)
    return doc, (np.arange(n.sum()) - (np.cumsum(n) - n)[doc]) * stride


class Words:
    """Distinct words of some texts, with the buckets of their n-grams."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray):
        found, first, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.hash, self.bucket = found, (found >> np.uint64(64 - BITS)).astype(np.int64)
        start, self.length = start[first], end[first] - start[first]
        size = self.length + 2
        self.at = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        inner = np.arange(size.sum()) - self.at[owner]
        chars = np.where((inner == 0) | (inner == size[owner] - 1), 0, data[np.clip(start[owner] + inner - 1, 0, max(0, len(data) - 1))] if len(data) else 0).astype(np.uint64)
        left = size[owner] - inner  # characters from here to the end of the word
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        code = np.zeros(len(chars), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            code = (code << np.uint64(8)) | np.append(chars[n - 1 :], np.zeros(min(n - 1, len(chars)), np.uint64))
            if n in ORDERS:
                mixed = (code + np.uint64(n)) * _MIX
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
                self.grams[n] = (mixed >> np.uint64(64 - BITS)).astype(np.int64), left >= n
        self.owner = owner


@dataclass
class Evidence:
    """Log-odds by bucket of words and of n-grams of each length."""

    words: np.ndarray
    grams: dict[int, np.ndarray]

    def inputs(self, w: Words) -> np.ndarray:
        """CHANNELS numbers per distinct word."""
        out = np.zeros((len(w.bucket), CHANNELS), np.float32)
        if not len(out):
            return out
        out[:, 0] = self.words[w.bucket]
        for k, n in enumerate(ORDERS):
            bucket, whole = w.grams[n]
            value = np.where(whole, self.grams[n][bucket], -np.inf).astype(np.float32)
            most = np.maximum.reduceat(value, w.at)
            out[:, 1 + k] = np.where(np.isfinite(most), most, 0)
            if n == 4:
                total = np.add.reduceat(np.where(whole, self.grams[n][bucket], 0).astype(np.float32), w.at)
                out[:, -1] = total / np.maximum(1, w.length - 1)
        return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds of a bucket's occurrences, less two standard errors, between -2 and 3."""
    a = 0.5
    raw = np.log((toxic + a) / (n_toxic + 2 * a)) - np.log((clean + a) / (n_clean + 2 * a))
    error = np.sqrt(1 / (toxic + a) + 1 / (clean + a))
    return np.clip(np.sign(raw) * np.maximum(0, np.abs(raw) - 2 * error) / 2, -2, 3).astype(np.float32)


def gather_evidence(w: Words, window: np.ndarray, toxic: np.ndarray, used: np.ndarray) -> Evidence:
    """From the windows marked in `used`: `window` has each word's window, `toxic` each window's label.

    A word counts once between the same two neighbours, so that copies of a text
    and repeated passages count once.
    """
    same = window[1:] == window[:-1]
    before, after = np.zeros(len(window), np.uint64), np.zeros(len(window), np.uint64)
    before[1:][same], after[:-1][same] = w.hash[w.of[:-1][same]], w.hash[w.of[1:][same]]
    place = mix(mix(before + np.uint64(1)) + w.hash[w.of] * np.uint64(3) + after * np.uint64(7))
    per_word = []
    for y in (True, False):
        at = np.flatnonzero(used[window] & (toxic[window] == y))
        at = at[np.unique(place[at], return_index=True)[1]]
        per_word.append(np.bincount(w.of[at], minlength=len(w.bucket)))
    n_toxic, n_clean = (int(c.sum()) for c in per_word)

    def by_bucket(bucket: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        counts = [np.bincount(bucket, c if owner is None else c[owner], 1 << BITS) for c in per_word]
        return log_odds(*counts, n_toxic, n_clean)

    return Evidence(by_bucket(w.bucket), {n: by_bucket(bucket[whole], w.owner[whole]) for n, (bucket, whole) in w.grams.items()})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters by name; w*, u*, b*, c* of the forward (f) and the backward (r) unit, then attention and output."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, rng: np.random.Generator, kind=np.float32) -> Network:
        def normal(*shape):
            return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(kind)

        p = {}
        for d in "fr":
            p |= {f"w{d}": normal(CHANNELS, 3 * HIDDEN), f"u{d}": normal(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, kind), f"c{d}": np.zeros(3 * HIDDEN, kind)}
        return cls(p | {"a": normal(2 * HIDDEN, ATTENTION), "ab": np.zeros(ATTENTION, kind), "v": normal(ATTENTION), "o": normal(2 * HIDDEN), "ob": np.zeros(1, kind)})

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """What the gates of both units take from each word: computed once per distinct word."""
        return np.concatenate([inputs @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fr"], 1)

    def states(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """time x windows x HIDDEN states of one unit; `gates` is time x windows x 3 HIDDEN, `mask` time x windows x 1."""
        u, c, h = self.p[f"u{d}"], self.p[f"c{d}"], HIDDEN
        state = np.zeros((gates.shape[1], h), gates.dtype)
        out = np.empty((*gates.shape[:2], h), gates.dtype)
        for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
            q = state @ u + c
            rz = sigmoid(gates[t][:, : 2 * h] + q[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            n = np.tanh(gates[t][:, 2 * h :] + r * q[:, 2 * h :])
            new = n + z * (state - n)
            if keep is not None:
                keep.append((t, state, q, r, z, n))
            state = np.where(mask[t], new, state)
            out[t] = state
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Logits of windows, and what the way back needs."""
        s = np.tanh(states @ self.p["a"] + self.p["ab"])
        e = np.where(mask[..., 0], s @ self.p["v"], -np.inf)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        context = np.einsum("tn,tnh->nh", alpha, states)
        return context @ self.p["o"] + self.p["ob"], s, alpha, context

    def logits(self, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """`gates` has both units' projections, time x windows x 6 HIDDEN."""
        states = np.concatenate([self.states(gates[..., : 3 * HIDDEN], mask, "f"), self.states(gates[..., 3 * HIDDEN :], mask, "r")], 2)
        return self.pooled(states, mask)[0]

    def slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log loss of windows (time x windows x CHANNELS) and its slope in every parameter, back through time."""
        gates, kept, h = self.projected(x.reshape(-1, CHANNELS)).reshape(*x.shape[:2], -1), {"f": [], "r": []}, HIDDEN
        states = np.concatenate([self.states(gates[..., 3 * h * k : 3 * h * (k + 1)], mask, d, kept[d]) for k, d in enumerate("fr")], 2)
        logit, s, alpha, context = self.pooled(states, mask)
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum())
        g = {}
        up = weight * (sigmoid(logit) - y)
        g["o"], g["ob"] = context.T @ up, up.sum(keepdims=True)
        d_context = up[:, None] * self.p["o"]
        d_alpha = np.einsum("tnh,nh->tn", states, d_context)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        d_pre = d_e[..., None] * self.p["v"] * (1 - s * s)
        g["v"], g["a"], g["ab"] = np.einsum("tn,tnk->k", d_e, s), np.einsum("tnh,tnk->hk", states, d_pre), d_pre.sum((0, 1))
        d_states = alpha[..., None] * d_context + d_pre @ self.p["a"].T
        for k, d in enumerate("fr"):
            u = self.p[f"u{d}"]
            gw, gu, gb, gc = (np.zeros_like(self.p[f"{c}{d}"]) for c in "wubc")
            carry = np.zeros_like(states[0, :, :h])
            for t, before, q, r, z, n in reversed(kept[d]):
                dh = d_states[t, :, k * h : (k + 1) * h] + carry
                dn_ = np.where(mask[t], dh, 0)
                a_n = dn_ * (1 - z) * (1 - n * n)
                a_z = dn_ * (before - n) * z * (1 - z)
                a_r = a_n * q[:, 2 * h :] * r * (1 - r)
                dp, dq = np.concatenate([a_r, a_z, a_n], 1), np.concatenate([a_r, a_z, a_n * r], 1)
                gw += x[t].T @ dp
                gb += dp.sum(0)
                gu += before.T @ dq
                gc += dq.sum(0)
                carry = dh - dn_ + dn_ * z + dq @ u.T
            g |= {f"w{d}": gw, f"u{d}": gu, f"b{d}": gb, f"c{d}": gc}
        return loss, g


@dataclass
class Model:
    evidence: Evidence | None
    network: Network | None
    pool: np.ndarray | None = None  # what a text's worst window and its mean window count for, and a constant
    offset: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        """0 to 1 for each text; a text without a letter has 0."""
        x = TextBatch(texts, lower=True)
        out = np.zeros(x.n)
        if self.network is None:
            return out
        start, end, doc = letter_runs(x)
        hashes = x.hashes(start, end)
        n_words = np.bincount(doc, minlength=x.n)
        first = np.cumsum(n_words) - n_words
        own, at = window_starts(n_words)
        at = first[own] + at
        until = np.minimum(at + WINDOW, first[own] + n_words[own])
        logits = np.empty(len(own))
        for k in range(0, len(own), TOGETHER):
            a, b = at[k], until[k : k + TOGETHER].max()
            w = Words(x.bytes, start[a:b], end[a:b], hashes[a:b])
            gates = self.network.projected(self.evidence.inputs(w))
            for m in range(k, min(k + TOGETHER, len(own)), BLOCK):
                part = slice(m, min(m + BLOCK, k + TOGETHER))
                place = at[part] + np.arange(WINDOW)[:, None]
                mask = place < until[part]
                logits[part] = self.network.logits(gates[w.of[np.minimum(place, b - 1) - a]], mask[..., None])
        worded = np.flatnonzero(n_words)
        if len(worded):
            out[worded] = np.round(sigmoid(pooled_windows(logits, np.searchsorted(own, worded)) @ self.pool + self.offset), 6)
        return out


def pooled_windows(logits: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each text, whose windows begin at `start`: the worst window's logit, the logarithm of the mean probability, and one."""
    n = np.diff(np.append(start, len(logits)))
    mean = np.add.reduceat(sigmoid(logits), start) / n
    return np.stack([np.clip(np.maximum.reduceat(logits, start), -10, 10), np.log(mean + 1e-4), np.ones(len(start))], 1)


def fit_pool(x: np.ndarray, y: np.ndarray, rounds: int = 30, decay: float = 0.02) -> np.ndarray:
    """Logistic weights by Newton steps; both labels count alike."""
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    out = np.array([1.0, 0.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ out)
        slope = x.T @ (weight * (p - y)) + decay * np.array([out[0] - 1, out[1], 0])
        bend = (x.T * (weight * np.maximum(1e-6, p * (1 - p)))) @ x + np.diag([decay, decay, 1e-6])
        out = out - np.clip(np.linalg.solve(bend, slope), -1, 1)
    return out


def fit(windows: list[str], doc: np.ndarray, toxic: np.ndarray, prior: float | None = None, epochs: int = EPOCHS, steps: int = STEPS, seed: int = 7) -> Model:
    """A model from windows of at most WINDOW words; `doc` and `toxic` (of its document) tell of each window.

    `prior` is the share of toxic documents where the model will be used; scores
    are moved from the sample's share to it.  Without documents of both labels
    the score is 0.  Training passes over the windows until it has made both
    `epochs` passes and `steps` steps.
    """
    doc, toxic = np.asarray(doc, np.int64), np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model(None, None)
    _, doc = np.unique(doc, return_inverse=True)
    x = TextBatch(pa.array(windows, pa.string()), lower=True)
    start, end, window = letter_runs(x)
    w = Words(x.bytes, start, end, x.hashes(start, end))
    count = np.bincount(window, minlength=x.n)
    place = np.arange(len(window)) - (np.cumsum(count) - count)[window]
    mask = (np.arange(WINDOW)[:, None] < np.minimum(count, WINDOW))[..., None]
    inputs = np.zeros((WINDOW, x.n, CHANNELS), np.float32)
    inside = place < WINDOW
    # Documents of a label are dealt to folds in turn, so that each fold has both.
    label = np.zeros(doc.max() + 1, bool)
    label[doc] = toxic
    fold_of = np.zeros(len(label), np.int64)
    for y in (True, False):
        fold_of[label == y] = np.arange((label == y).sum()) % FOLDS
    fold = fold_of[doc]
    for f in range(FOLDS):
        told = gather_evidence(w, window, toxic, fold != f).inputs(w)
        own = inside & (fold[window] == f)
        inputs[place[own], window[own]] = told[w.of[own]]
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    first, second, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    # Before the first epoch, the strongest evidence of a window stands for its score.
    score = inputs.sum(2).max(0)
    usable = count > 0
    passed = 0
    while passed < epochs or step < steps:
        passed += 1
        order = np.lexsort((-score, doc))
        top = np.ones(len(order), bool)
        top[1:] = doc[order][1:] != doc[order][:-1]
        chosen = np.unique(np.concatenate([order[top], rng.permutation(np.flatnonzero(~toxic))[: 2 * int((~label).sum())]]))
        chosen = rng.permutation(chosen[usable[chosen]])
        share = max(1, toxic[chosen].sum()), max(1, (~toxic[chosen]).sum())
        weight = np.where(toxic[chosen], 0.5 / share[0], 0.5 / share[1]) * len(chosen)
        for k in range(0, len(chosen), BATCH):
            at = chosen[k : k + BATCH]
            _, slope = net.slopes(inputs[:, at], mask[:, at], toxic[at].astype(np.float32), (weight[k : k + BATCH] / len(at)).astype(np.float32))
            step += 1
            size = np.sqrt(sum(float((v * v).sum()) for v in slope.values()))
            for name, v in slope.items():
                v = v * min(1.0, 5 / (size + 1e-9)) + DECAY * net.p[name]
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                net.p[name] = (net.p[name] - 0.01 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        score = np.concatenate([net.logits(net.projected(inputs[:, k : k + BLOCK].reshape(-1, CHANNELS)).reshape(WINDOW, -1, 6 * HIDDEN), mask[:, k : k + BLOCK]) if usable[k : k + BLOCK].all() else _some(net, inputs[:, k : k + BLOCK], mask[:, k : k + BLOCK]) for k in range(0, x.n, BLOCK)])
    offset = float(np.log(prior / (1 - prior))) if prior and 0 < prior < 1 else 0.0
    order = np.argsort(doc[usable], kind="stable")
    texts, begin = np.unique(doc[usable][order], return_index=True)
    pool = fit_pool(pooled_windows(score[usable][order].astype(float), begin), label[texts])
    return Model(gather_evidence(w, window, toxic, np.ones(x.n, bool)), net, pool, offset)


def _some(net: Network, inputs: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits where some windows have no word: theirs are -30."""
    out = np.full(inputs.shape[1], -30.0, np.float32)
    has = mask[:, :, 0].any(0)
    if has.any():
        part = inputs[:, has]
        out[has] = net.logits(net.projected(part.reshape(-1, CHANNELS)).reshape(WINDOW, -1, 6 * HIDDEN), mask[:, has])
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of chosen texts, side by side: at most MAX_WINDOWS of a text, at even steps, and none above MAX_BYTES."""
    for batch in slices(batches, "text"):
        x = TextBatch(batch.column("text"), lower=True)
        start, end, doc = letter_runs(x)
        n_words = np.bincount(doc, minlength=x.n)
        first = np.cumsum(n_words) - n_words
        key, toxic = batch.column("h").to_pylist(), batch.column("toxic").to_pylist()
        rows = []
        for d in range(x.n):
            n = -(-n_words[d] // WINDOW)
            for k in np.unique(np.arange(min(n, MAX_WINDOWS)) * n // max(1, min(n, MAX_WINDOWS))):
                a, b = first[d] + k * WINDOW, first[d] + min(n_words[d], (k + 1) * WINDOW)
                if (end[a:b] - start[a:b]).sum() <= MAX_BYTES:
                    rows.append((key[d], toxic[d], " ".join(x.bytes[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(start[a:b], end[a:b]))))
        h, y, words = list(zip(*rows)) or ((), (), ())
        yield pa.record_batch([pa.array(h, pa.int64()), pa.array(y, pa.int32()), pa.array(words, pa.string())], ["h", "toxic", "words"])


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, **training) -> Model:
    """Fit on `docs` (doc_id, text) and `labels` (doc_id, toxic); both must be the training fold already.

    A text is toxic or clean if all labels of all its copies say so; others are
    left out.  Of each label at most max_docs distinct texts are read, those of
    least hash.  Without texts of both labels every score is 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    hashed = short_batches(docs).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"))
    texts = hashed.join(known, "doc_id").groupBy("h").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most and toxic in (0, 1)").select("h", "toxic").persist()
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        texts.unpersist()
        return Model(None, None)
    drawn = []
    for y in (0, 1):
        key = F.abs(F.xxhash64("h", F.lit(3)).cast("double"))
        drawn += texts.where((F.col("toxic") == y) & (key <= F.lit(2.0**63 * min(1.0, 2 * max_docs / n[y])))).orderBy(key, "h").limit(max_docs).collect()  # max_docs rows at most
    texts.unpersist()
    chosen = docs.sparkSession.createDataFrame([(r["h"], r["toxic"]) for r in drawn], "h long, toxic int")
    rows = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text").join(F.broadcast(chosen), "h").groupBy("h", "toxic").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(_windows, "h long, toxic int, words string").toPandas().sort_values(["h", "words"])
    return fit(got["words"].tolist(), got["h"].to_numpy(), got["toxic"].to_numpy() == 1, n[1] / (n[0] + n[1]), **training)


def classify(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add `score` (double) and `predicted` (1 if score >= threshold) to each row; columns of these names are replaced.

    Whole texts count, all their windows.  A null text counts as empty; texts
    without a letter score 0.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([sent.value.scores(p) for p in pieces(texts)]))

    out = short_batches(df).withColumn("score", score(F.col(f"`{text_col}`")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
