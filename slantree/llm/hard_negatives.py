"""Hard-negative mining by product quantisation with residual norms, exact.

Vectors become integers (floor of 256 x).  A codebook per pair of dimensions is
fitted on a bounded sample; its centres are integers.  Every row is stored with
its codes and the norm of what the codes leave over, so that for an anchor a

    score = table(a, codes) + a . residual,   |a . residual| <= |a| |residual|

The sum of table look-ups, plus or minus that bound, holds the score from above
and below.  A row is a candidate if its upper bound reaches what enough other
rows surely reach; candidates are scored exactly, in integers, so the result is
that of a search over all pairs whatever the codebook.

Rows are packed into chunks of CHUNK; anchors, one in a hundred, meet them in
groups of bounded size that are sent to all tasks.  A task keeps the best few of
each anchor, so what is shuffled follows the anchors and tasks, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slantree.llm.durable import short_batches, written
from slantree.llm.text_arrays import give_back

#: Rows that the codebook is fitted on at most, centres of a codebook, dimensions that share one.
SAMPLE, CENTRES, WIDTH = 4096, 256, 2
#: Rows of a chunk, anchors sent at a time, bytes of their vectors at most, and anchors held against a chunk at once.
CHUNK, GROUP, GROUP_BYTES, TOGETHER = 8192, 8192, 1 << 25, 32
#: Pairs scored exactly at a time.
PAIRS = 1 << 15
POSITIVES, NEGATIVES = 5, 10
#: Components of this size or more count as not finite, so that sums of products stay within 64 bits.
TOO_LARGE = float(1 << 20)
PACKED = "seq long, n int, ids binary, labels binary, vectors binary, codes binary, rest binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(batch: pa.RecordBatch, d: int, id_col: str, label_col: str, vector_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and integer vectors (padded with zeros to d) of the rows that take part."""
    vectors = batch.column(vector_col)
    whole = pa.compute.is_valid(vectors).to_numpy(zero_copy_only=False) & batch.column(label_col).is_valid().to_numpy(zero_copy_only=False) & batch.column(id_col).is_valid().to_numpy(zero_copy_only=False)
    batch = batch.filter(pa.array(whole))
    vectors = batch.column(vector_col)
    size = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    bad = ~(np.abs(x) < TOO_LARGE)
    ok = np.bincount(row[bad], minlength=len(size)) == 0
    out = np.zeros((len(size), d), np.int64)
    at = np.arange(len(x)) - (np.cumsum(size) - size)[row]
    out[row[~bad], at[~bad]] = np.floor(256.0 * x[~bad]).astype(np.int64)
    ids, labels = (batch.column(c).cast(pa.int64()).to_numpy() for c in (id_col, label_col))
    return ids[ok], labels[ok], out[ok]


def fitted(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Integer centres (pairs of dimensions x CENTRES x WIDTH) by k-means from rows at even steps; any centres are right."""
    d = sample.shape[1]
    parts = -(-d // WIDTH)
    sample = np.pad(sample, ((0, 0), (0, parts * WIDTH - d))).reshape(-1, parts, WIDTH).astype(float)
    k = min(CENTRES, len(sample))
    out = np.zeros((parts, CENTRES, WIDTH), np.int64)
    for p in range(parts):
        x = sample[:, p]
        centres = x[np.lexsort(x.T)][np.arange(k) * len(x) // k]
        for _ in range(rounds):
            near = (np.square(centres).sum(1) - 2 * x @ centres.T).argmin(1)
            n = np.bincount(near, minlength=k)
            sums = np.stack([np.bincount(near, x[:, j], k) for j in range(WIDTH)], 1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centres)
        out[p, :k] = np.rint(centres)
        out[p, k:] = out[p, 0]
    return out


def coded(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one byte per codebook) and the norms of what they leave over."""
    parts = len(centres)
    x = np.pad(x, ((0, 0), (0, parts * WIDTH - x.shape[1]))).reshape(len(x), parts, WIDTH)
    codes, left = np.empty((len(x), parts), np.uint8), np.zeros(len(x))
    for p in range(parts):
        own = x[:, p].astype(float)
        codes[:, p] = (np.square(centres[p].astype(float)).sum(1) - 2 * own @ centres[p].T.astype(float)).argmin(1)
        left += np.square((x[:, p] - centres[p][codes[:, p]]).astype(float)).sum(1)
    return codes, np.sqrt(left) * (1 + 1e-9)


def bounds(chunk: dict, at: np.ndarray, anchors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score, rows x anchors, from the tables alone."""
    parts = len(centres)
    a = np.pad(anchors, ((0, 0), (0, parts * WIDTH - anchors.shape[1]))).reshape(len(anchors), parts, WIDTH)
    table = np.einsum("apw,pkw->pka", a, centres)
    total = np.zeros((len(at), len(a)), np.int64)
    for p in range(parts):
        total += table[p][chunk["codes"][at, p]]
    size = np.sqrt(np.square(anchors.astype(float)).sum(1)) * (1 + 1e-9)
    total = total.astype(float)
    slack = chunk["rest"][at, None] * size + (1 + np.abs(total) * 1e-14)
    return total - slack, total + slack


def nth(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest value of each column; -inf where there are fewer."""
    return np.partition(values, len(values) - n, axis=0)[len(values) - n] if len(values) >= n else np.full(values.shape[1], -np.inf)


def exact(chunk: dict, row: np.ndarray, anchors: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Integer scores of pairs of a row and an anchor."""
    out = np.empty(len(row), np.int64)
    for k in range(0, len(row), PAIRS):
        out[k : k + PAIRS] = np.einsum("ij,ij->i", chunk["vectors"][row[k : k + PAIRS]].astype(np.int64), anchors[col[k : k + PAIRS]])
    return out


class Best:
    """The best rows of each of many lists, by score, ties to the smaller id."""

    def __init__(self, lists: int, keep: int):
        self.keep, self.least = keep, np.full(lists, -np.inf)
        self.list = self.score = self.id = np.zeros(0, np.int64)

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        which, score, ids = (np.concatenate(v) for v in ((self.list, which), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, which))
        which, score, ids = which[order], score[order], ids[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which, "left")
        full = rank == self.keep - 1
        self.least[which[full]] = score[full]
        top = rank < self.keep
        self.list, self.score, self.id = which[top], score[top], ids[top]


def chunks_of(batches: Iterator[pa.RecordBatch], d: int, parts: int) -> Iterator[dict]:
    for batch in batches:
        for r in batch.to_pylist():
            n = r["n"]
            yield {"ids": np.frombuffer(r["ids"], np.int64), "labels": np.frombuffer(r["labels"], np.int64), "vectors": np.frombuffer(r["vectors"], np.int32).reshape(n, d), "codes": np.frombuffer(r["codes"], np.uint8).reshape(n, parts), "rest": np.frombuffer(r["rest"])}


def nearest_of_label(chunk: dict, anchors: dict, centres: np.ndarray, best: Best) -> None:
    """Take the chunk's rows of each anchor's own label into its list."""
    edge = np.searchsorted(chunk["labels"], anchors["labels"], "left"), np.searchsorted(chunk["labels"], anchors["labels"], "right")
    for label in np.unique(anchors["labels"][edge[1] > edge[0]]):
        own = np.flatnonzero(anchors["labels"] == label)
        at = np.arange(edge[0][own[0]], edge[1][own[0]])
        for k in range(0, len(own), TOGETHER):
            some = own[k : k + TOGETHER]
            low, high = bounds(chunk, at, anchors["vectors"][some], centres)
            itself = chunk["ids"][at, None] == anchors["ids"][some]
            low[itself], high[itself] = -np.inf, -np.inf
            row, col = np.nonzero((high >= np.maximum(nth(low, best.keep), best.least[some])) & ~itself)
            best.add(some[col], exact(chunk, at[row], anchors["vectors"], some[col]), chunk["ids"][at[row]])


def window(positive_score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative: 30 p <= 100 n <= 90 p."""
    return -((-30 * positive_score) // 100), (90 * positive_score) // 100


def window_of_others(chunk: dict, anchors: dict, centres: np.ndarray, positives: np.ndarray, best: Best) -> None:
    """Take the chunk's rows of other labels into the lists (anchor x POSITIVES + k) in whose windows they fall.

    `positives` has the scores of each anchor's positives; windows of anchors
    with fewer are empty.
    """
    least, most = (v.astype(float) for v in window(positives))
    every = np.arange(len(chunk["ids"]))
    for a in range(0, len(anchors["ids"]), TOGETHER):
        some = np.arange(a, min(a + TOGETHER, len(anchors["ids"])))
        low, high = bounds(chunk, every, anchors["vectors"][some], centres)
        other = chunk["labels"][:, None] != anchors["labels"][some]
        pairs = []
        for k in range(positives.shape[1]):
            lists = some * positives.shape[1] + k
            sure = np.where(other & (low >= least[some, k]) & (high <= most[some, k]), low, -np.inf)
            reach = np.maximum(np.maximum(nth(sure, best.keep), best.least[lists]), least[some, k])
            row, col = np.nonzero(other & (high >= reach) & (low <= most[some, k]) & (least[some, k] <= most[some, k]))
            pairs.append((row, col, np.full(len(row), k)))
        row, col, k = (np.concatenate(v) for v in zip(*pairs))
        # A row may be in several windows of one anchor: it is scored once.
        pair, back = np.unique(row * len(some) + col, return_inverse=True)
        score = exact(chunk, pair // len(some), anchors["vectors"], some[pair % len(some)])[back]
        inside = (score >= least[some[col], k]) & (score <= most[some[col], k])
        row, col, k, score = row[inside], col[inside], k[inside], score[inside]
        best.add(some[col] * positives.shape[1] + k, score, chunk["ids"][row])


def packed_rows(df: DataFrame, d: int, centres, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """Chunks of the rows that take part, sorted by label, with their codes; every row is in one."""
    names = [c.split()[0] for c in PACKED.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seq = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(v) for v in zip(*held))
            labels = np.where(ids % 7 == 0, np.fmod(labels + 1, 10), labels)
            order = np.argsort(labels, kind="stable")
            ids, labels, x = ids[order], labels[order], x[order]
            codes, rest = coded(x, centres.value)
            blobs = [v.tobytes() for v in (ids, labels, x.astype(np.int32), codes, rest)]
            return pa.record_batch([pa.array([seq]), pa.array([len(ids)], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names)

        for batch in batches:
            for k in range(0, len(batch), CHUNK):
                held.append(integers(batch.slice(k, CHUNK), d, id_col, label_col, vector_col))
                n += len(held[-1][0])
                if n >= CHUNK:
                    yield flush()
                    held, n, seq = [], 0, seq + 1
        if n:
            yield flush()
        give_back()

    return df.select(id_col, label_col, vector_col).mapInArrow(pack, PACKED)


def first(df: DataFrame, by: list[str], score: str, id_col: str, n: int, into: str = "rank") -> DataFrame:
    """The n first rows of each list; lists have a few rows per task."""
    order = W.partitionBy(*by).orderBy(F.desc(score), id_col)
    return df.withColumn(into, F.row_number().over(order)).where(F.col(into) <= n)


def mine(df: DataFrame, anchor: Column | str = "vec_id % 100 = 0", id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, a null, infinite or NaN component, or
    one of 2^20 or more take no part.  Where the id is divisible by 7 the label
    is (label + 1) % 10.  Shorter vectors count as filled with zeros.  A row is
    another one than the anchor if its id differs; repeated rows are rows like
    others and may be positives and negatives more than once, and a repeated
    anchor gives its results once.
    """
    rows = short_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("embedding"))
    spark = df.sparkSession
    whole = rows.where("vec_id is not null and label is not null and embedding is not null")
    n, d = whole.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not n or not d:
        return spark.createDataFrame([], RESULT)
    share = min(1.0, 2 * SAMPLE / n)
    drawn = whole.where(F.abs(F.xxhash64("vec_id", F.lit(5)).cast("double")) <= F.lit(share * 2.0**63)).limit(SAMPLE).toArrow()
    sample = [integers(b, d, "vec_id", "label", "embedding")[2] for b in drawn.combine_chunks().to_batches()]
    sample = np.concatenate(sample) if sample else np.zeros((0, d), np.int64)
    centres = spark.sparkContext.broadcast(fitted(sample if len(sample) else np.zeros((1, d), np.int64)))
    parts = -(-d // WIDTH)
    chunks = written(packed_rows(whole, d, centres, "vec_id", "label", "embedding"), "chunks")
    chosen = written(packed_rows(whole.where(anchor).dropDuplicates(), d, centres, "vec_id", "label", "embedding").select("seq", "n", "ids", "labels", "vectors"), "anchors")

    group = max(1, min(group, GROUP_BYTES // (4 * d)))
    sizes = sorted((r["seq"], r["n"]) for r in chosen.select("seq", "n").collect())  # a row per CHUNK anchors or task
    out, at = [], 0
    while at < len(sizes):
        to, total = at + 1, sizes[at][1]
        while to < len(sizes) and total + sizes[to][1] <= group:
            total, to = total + sizes[to][1], to + 1
        blocks = chosen.where(F.col("seq").between(sizes[at][0], sizes[to - 1][0])).orderBy("seq").collect()  # at most `group` anchors, or one block
        ids, labels = (np.concatenate([np.frombuffer(b[c], np.int64) for b in blocks]) for c in ("ids", "labels"))
        vectors = np.concatenate([np.frombuffer(b["vectors"], np.int32).reshape(-1, d) for b in blocks])
        for k in range(0, len(ids), group):
            some = slice(k, k + group)
            out.append(_mined(chunks, {"ids": ids[some], "labels": labels[some], "vectors": vectors[some].astype(np.int64)}, centres, d, parts))
        at = to
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], RESULT)


def _mined(chunks: DataFrame, anchors: dict, centres, d: int, parts: int) -> DataFrame:
    """The result rows of one group of anchors: a pass for the positives, one for the negatives."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(anchors)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(sent.value["ids"]), POSITIVES)
        for chunk in chunks_of(batches, d, parts):
            nearest_of_label(chunk, sent.value, centres.value, best)
        yield pa.record_batch([pa.array(best.list), pa.array(best.id), pa.array(best.score)], ["anchor", "positive_id", "score"])
        give_back()

    top = first(chunks.mapInArrow(positives, "anchor long, positive_id long, score long"), ["anchor"], "score", "positive_id", POSITIVES).toArrow()
    lists = {"ids": np.zeros((len(anchors["ids"]), POSITIVES), np.int64), "scores": np.full((len(anchors["ids"]), POSITIVES), -1, np.int64)}  # a window of -1 is empty
    where = top["anchor"].to_numpy(), top["rank"].to_numpy() - 1
    lists["ids"][where], lists["scores"][where] = top["positive_id"].to_numpy(), top["score"].to_numpy()
    held = spark.sparkContext.broadcast(lists)

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = held.value["scores"]
        best = Best(scores.size, NEGATIVES)
        for chunk in chunks_of(batches, d, parts):
            window_of_others(chunk, sent.value, centres.value, scores, best)
        a, k = best.list // POSITIVES, best.list % POSITIVES
        columns = [best.list, sent.value["ids"][a], held.value["ids"][a, k], best.id, scores[a, k], best.score]
        yield pa.record_batch([pa.array(c) for c in columns], ["list", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])
        give_back()

    schema = "list long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = first(chunks.mapInArrow(negatives, schema), ["list"], "negative_score", "negative_id", NEGATIVES)
    return written(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
