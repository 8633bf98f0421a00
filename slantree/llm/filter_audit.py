"""Filter interaction audit: what each filter removes in every order of the filters.

1. Rows with an id are range-sorted by (fingerprint, text, doc_id): dealt into
   ranges of (fingerprint, doc_id), so that a text of very many copies spans
   many ranges, and sorted within each by fingerprint, full text and id.
2. A pass over each sorted range compares every row with its predecessor.  Only
   the first row of a run of equal texts is measured; its copies share the
   outcome.  Rows of one fingerprint may go on in the next range, so the first
   rows of the runs at both ends of a range are held back with their text, and
   the least id of a text over all ranges decides about them.
3. Each document is now a failure mask of five bits.  Masks are counted by part
   (additive counters, 2^5 masks a part at most), and every order's and step's
   figures are sums of these counters; no document is read again.

Filters: A few words, B few distinct words, C many capitals, D a symbol, E a
text equal to one of a smaller doc_id, table-wide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slantree.llm.durable import short_batches, written
from slantree.llm.text_arrays import CONTINUES, TextBatch, give_back, pieces, slices

FILTERS = "ABCDE"
#: A: fewer words; B: fewer distinct words in a hundred; C: more capitals in a hundred code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|"]] = True
COPY = 1 << FILTERS.index("E")
PASSED = "doc_id long, part string, mask int, n long, fp long, text string, seq long"


def failures(texts: pa.Array) -> np.ndarray:
    """Bits of the filters that look at one text: A to D."""
    x = TextBatch(texts)
    start, end, doc = x.words()
    words = np.bincount(doc, minlength=x.n)
    hashes = x.hashes(start, end)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=x.n)
    points = x.per_doc(~CONTINUES[x.bytes])
    tests = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * x.per_doc(_UPPER[x.bytes]) > MOST_CAPITALS * points, x.per_doc(_SYMBOL[x.bytes]) > 0]
    return sum(t.astype(np.int64) << k for k, t in enumerate(tests))


def _batch(doc_id, part, mask, n, fp, text, seq) -> pa.RecordBatch:
    names = [c.split()[0] for c in PASSED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, k) for v, k in zip((doc_id, part, mask, n, fp, text, seq), kinds)], names)


class _Run:
    """A run of rows of equal text at one end of a range: its first rows are held back."""

    def __init__(self, fp: int, text: str, doc_id: int, mask: int):
        self.fp, self.text, self.doc_id, self.mask = fp, text, doc_id, mask
        self.parts: dict[str, int] = {}


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fp, text, doc_id, part) to failure masks, each row against its predecessor."""
    ends: list[_Run] = []  # runs of the range's first fingerprint
    open_: list[_Run] = []  # runs of the fingerprint read last
    first_fp = None
    seq = TaskContext.get().partitionId() << 32

    def settled(runs: list[_Run]) -> Iterator[pa.RecordBatch]:
        """First rows of runs that end within the range: no smaller id has their text."""
        rows = [(r.doc_id, part, r.mask, n) for r in runs for part, n in r.parts.items()]
        if rows:
            ids, parts, masks, n = zip(*rows)
            yield _batch(ids, parts, masks, n, [None] * len(rows), [None] * len(rows), [None] * len(rows))

    for batch in slices(batches, "text"):
        n = len(batch)
        if not n:
            continue
        fp, ids, text, part = (batch.column(c) for c in ("fp", "doc_id", "text", "part"))
        fp, ids, part = fp.to_numpy(), ids.to_numpy(), part.to_pylist()
        new = np.ones(n, bool)
        if n > 1:
            same_text = pa.compute.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = (fp[1:] != fp[:-1]) | ~same_text
        if open_ and fp[0] == open_[-1].fp and text[0].as_py() == open_[-1].text:
            new[0] = False
        start = np.flatnonzero(new)
        bits = np.concatenate([failures(p) for p in pieces(text.take(pa.array(start)))]) if len(start) else np.zeros(0, np.int64)
        run = np.cumsum(new) - 1  # -1: goes on from the batch before
        mask = np.where(run >= 0, bits[np.maximum(run, 0)] if len(bits) else 0, open_[-1].mask if open_ else 0)
        lead = np.where(run >= 0, ids[start[np.maximum(run, 0)]] if len(start) else 0, open_[-1].doc_id if open_ else 0)
        copy = ids > lead
        if copy.any():
            at = np.flatnonzero(copy)
            yield _batch(ids[at], [part[k] for k in at], mask[at] | COPY, np.ones(len(at), np.int64), [None] * len(at), [None] * len(at), [None] * len(at))
        done: list[_Run] = []
        for k in np.flatnonzero(~copy):  # first rows of runs, and other rows of the same id and text
            if new[k]:
                if open_ and open_[-1].fp != fp[k]:
                    if open_[-1].fp == first_fp:
                        ends += open_
                    else:
                        done += open_
                    open_ = []
                first_fp = fp[k] if first_fp is None else first_fp
                open_.append(_Run(int(fp[k]), text[k].as_py(), int(ids[k]), int(mask[k])))
            own = open_[-1].parts
            own[part[k]] = own.get(part[k], 0) + 1
        yield from settled(done)
    for r in [*ends, *open_]:
        rows = list(r.parts.items())
        yield _batch([r.doc_id] * len(rows), [p for p, _ in rows], [r.mask] * len(rows), [k for _, k in rows], [r.fp] * len(rows), [r.text] * len(rows), [seq] * len(rows))
    give_back()


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without an id: no copies of anything."""
    for batch in slices(batches, "text"):
        n = len(batch)
        bits = np.concatenate([failures(p) for p in pieces(batch.column("text"))])
        none = [None] * n
        yield _batch(none, batch.column("part"), bits, np.ones(n, np.int64), none, none, none)


def failure_masks(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask (bit k for filter k of FILTERS), n: rows of one doc_id, part and text may share a row, n counts them.

    A null text counts as empty, a null part as the empty string.  A row without
    an id is no copy and has none.  Rows of one id and text are not copies of
    each other.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = short_batches(df).select(F.xxhash64(text).alias("fp"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    dealt = docs.where("doc_id is not null").repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    rows = written(dealt.mapInArrow(_compared, PASSED).union(docs.where("doc_id is null").select("text", "part").mapInArrow(_alone, PASSED)), "masks")
    # A text at the ends of ranges has a row per range that it spans.
    least = F.min("doc_id").over(W.partitionBy("fp", "text"))
    edges = rows.where("text is not null").withColumn("mask", F.when(F.col("doc_id") > least, F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")))
    return rows.where("text is null").select("doc_id", "part", "mask", "n").union(edges.select("doc_id", "part", "mask", "n"))


def part_counters(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: how many documents failed just the filters of `mask`, and how many of those are labelled so.

    A document is good (toxic) if any label row of its id says so.  Counters of
    several tables can be added.
    """
    yes = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "_good"), ("toxic", "_toxic"))]
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(*yes)
    joined = masks.join(known, "doc_id", "left")

    def counted(flag: str):
        return F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0).cast("long"))

    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("_good").alias("good"), counted("_toxic").alias("toxic"))


def audit(counters: DataFrame, filters: str = FILTERS, orders: Sequence[str] | None = None) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    `orders` are all permutations of `filters` unless given.  shapley is what a
    step's filter removes, summed over all permutations: a document with m
    failures is removed by each of them in 1 / m of these.
    """
    orders = ["".join(p) for p in permutations(filters)] if orders is None else orders
    every = factorial(len(filters))
    steps = []
    for order in orders:
        before = 0
        for k, name in enumerate(order):
            bit = 1 << filters.index(name)
            steps.append((order, k + 1, bit, before))
            before |= bit
    per_part = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # 2 ** filters at most
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, s, b, p in steps]))
    at = per_part.withColumn("s", rows).select("part", "s.filter_order", "s.step", F.expr("cast(s.bit as int)").alias("bit"), F.expr("cast(s.before as int)").alias("before"), "c")

    def total(test: str, value: str = "x.n") -> str:
        return f"aggregate(c, 0L, (t, x) -> t + if({test}, {value}, 0L))"

    here = "(x.mask & before) = 0 and (x.mask & bit) <> 0"
    figures = {
        "kept": total("(x.mask & (before | bit)) = 0"),
        "removed": total(here),
        "redundant": total("(x.mask & bit) <> 0 and (x.mask & before) <> 0"),
        "unique_fails": total("x.mask = bit"),
        "good_lost": total(here, "x.good"),
        "toxic_lost": total(here, "x.toxic"),
        "shapley": total("(x.mask & bit) <> 0", f"x.n * ({every}L div bit_count(x.mask))"),
    }
    return at.select("part", "filter_order", "step", *[F.expr(e).alias(c) for c, e in figures.items()])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of FILTERS over `docs` (doc_id, text, lang) and `labels` (doc_id, quality, toxic); an empty table has no part."""
    return audit(part_counters(failure_masks(docs), labels))
