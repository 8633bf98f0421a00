"""Best-fit packing of token sequences, planned on counts of lengths.

Large-item matching: pieces above a third of the capacity fit at most twice
into a sequence, so the longest is matched with the longest other that still
fits.  Smaller pieces then go, longest first, into the tightest gap.  Both
steps only need how many pieces there are of each length (at most `capacity`
numbers, whatever the input), so the plan is made from counts: "the pieces of
length L ranked r0..r1 go to sequences b, b+1, ..., from this offset".  Spark
numbers the pieces of each length across its partitions and looks each one up.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slantree.llm.bpe_trie import byte_characters
from slantree.llm.durable import short_batches, written
from slantree.llm.text_arrays import give_back, slices

#: Plans up to this many rows (about 40 bytes each) are sent to every task; larger ones are joined by length and rank block.
MAX_SENT_ROWS = 200_000
#: Ranks per block of the joined form.
BLOCK = 1 << 16
#: Words that a worker remembers (about 200 bytes each).
MAX_WORDS = 200_000
#: The library's lower-casing and splitting agree with Python's on these characters; texts with others go to the library whole.
_COMMON = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ſ‐-‧‰-⁞€]*")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordIds(dict):
    """Ids of blank-delimited words as little-endian 32-bit numbers, filled on demand by the tokenizers library.

    It holds at most MAX_WORDS words: a full half becomes the older one, from
    which words still in use come back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, byte_characters()
        self.older: dict[str, bytes] = {}

    def tokenized(self, word: str) -> bytes:
        raw = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(raw)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            if word.isalpha():
                out = self.tokenized(word)
            elif (bare := word.rstrip(".,")).isalpha():
                out = self[bare] + self[word[len(bare) :]]
            else:
                parts = _SPLIT.findall(word)
                out = self.tokenized(word) if parts == [word] else b"".join([self[w] for w in parts])
        if len(self) >= MAX_WORDS // 2:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if _COMMON.fullmatch(text) and "<|" not in text:
            return b"".join([self[w] for w in text.lower().split()])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut(df: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tokenize whole texts, end each with `end_id`, and cut only those above `capacity`.

    One row per piece: the id column, piece, start, length, ids_crc32, and
    where it was made (part, seq): seq numbers a part's pieces of one length.
    A null text counts as empty and yields one piece of one token.
    """
    kind = df.schema[id_col].dataType

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path)
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, text_col, 1 << 22):
            rows: list[tuple] = []
            for key, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist()):
                ids = own.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    raw = ids[at : at + 4 * capacity]
                    rows.append((key, k, at // 4, len(raw) // 4, zlib.crc32(raw), part, int(seen[len(raw) // 4])))
                    seen[len(raw) // 4] += 1
            columns = list(zip(*rows)) or [()] * 7
            yield pa.record_batch(
                [pa.array(columns[0], batch.schema.field(id_col).type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                [id_col, "piece", "start", "length", "ids_crc32", "part", "seq"],
            )
        give_back()

    schema = f"`{id_col}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, part long, seq long"
    return short_batches(df).select(id_col, text_col).mapInArrow(pieces_of, schema)


def plan(counts: dict[int, int], capacity: int = 4096) -> pd.DataFrame:
    """Where the pieces of each length go, from how many there are of each.

    Columns: length, first and last rank (exclusive), first sequence, pieces of
    this length per sequence, offset of the first of them.  Work and size follow
    the number of distinct lengths and gaps, not the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, how many)
    bins = 0

    def put(length: int, first: int, count: int, per: int, offset: int) -> None:
        rows.append((length, rank[length], rank[length] + count * per, first, per, offset))
        rank[length] += count * per
        left[length] -= count * per

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            gaps.setdefault(gap, []).append((first, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        mates = [m for m in large if m <= min(n, capacity - n)]
        for m in mates:
            if not left[n]:
                break
            k = left[n] // 2 if m == n else min(left[n], left[m])
            if not k:
                continue
            if m == n:
                put(n, bins, k, 2, 0)
            else:
                put(n, bins, k, 1, 0)
                put(m, bins, k, 1, n)
            leave(capacity - n - m, bins, k)
            bins += k
        if left[n]:
            k = left[n]
            put(n, bins, k, 1, 0)
            leave(capacity - n, bins, k)
            bins += k
    import bisect

    open_gaps = sorted(gaps)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(open_gaps, n)
            if at == len(open_gaps):
                per = min(capacity // n, left[n])
                k = left[n] // per
                put(n, bins, k, per, 0)
                gap, first = capacity - per * n, bins
                bins += k
            else:
                wide = open_gaps[at]
                first, room = gaps[wide].pop()
                if not gaps[wide]:
                    del gaps[wide]
                    open_gaps.pop(at)
                per = min(wide // n, left[n])
                k = min(room, left[n] // per)
                put(n, first, k, per, capacity - wide)
                if k < room:
                    if wide not in gaps:
                        bisect.insort(open_gaps, wide)
                    leave(wide, first + k, room - k)
                gap = wide - per * n
            if gap:
                if gap not in gaps:
                    bisect.insort(open_gaps, gap)
                leave(gap, first, k)
    out = pd.DataFrame(rows, columns=["length", "rank0", "rank1", "bin0", "per", "offset0"], dtype=np.int64)
    return out.sort_values(["length", "rank0"], ignore_index=True)


def _place(length: np.ndarray, rank: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; `table` holds the plan's columns, sorted by length and rank0."""
    span = np.int64(1) << 44
    at = np.searchsorted(table[:, 0] * span + table[:, 1], length * span + rank, "right") - 1
    got = table[at]
    k = rank - got[:, 1]
    return got[:, 3] + k // got[:, 4], got[:, 5] + (k % got[:, 4]) * length


def assign(pieces: DataFrame, capacity: int = 4096, max_sent_rows: int = MAX_SENT_ROWS, block: int = BLOCK) -> DataFrame:
    """Give every piece its sequence_id and offset; `pieces` (from `cut`) must be a written table."""
    spark = pieces.sparkSession
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = plan(counts, capacity)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        pieces.join(per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n"), ["length", "part"])
        .withColumn("rank", F.col("base") + F.col("seq"))
        .drop("base", "part", "seq")
    )
    names = [c for c in ranked.columns if c != "rank"]
    fields = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def filled(batch: pa.RecordBatch, plan_rows: np.ndarray) -> pa.RecordBatch:
        ids, offset = _place(batch.column("length").to_numpy(), batch.column("rank").to_numpy(), plan_rows)
        return pa.record_batch([*(batch.column(c) for c in names), pa.array(ids), pa.array(offset)], [*names, "sequence_id", "offset"])

    if len(table) <= max_sent_rows:
        sent = spark.sparkContext.broadcast(table.to_numpy())

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield filled(batch, sent.value)

        return ranked.mapInArrow(look_up, fields)

    # The same look-up group by group: a plan row is copied to each block of ranks that it covers.
    wide = spark.createDataFrame(table).withColumn("block", F.explode(F.sequence((F.col("rank0") / block).cast("long"), ((F.col("rank1") - 1) / block).cast("long"))))

    def look_up_group(left: pa.Table, right: pa.Table) -> pa.Table:
        own = np.stack([right.column(c).to_numpy() for c in ("length", "rank0", "rank1", "bin0", "per", "offset0")], 1)
        own = own[np.lexsort((own[:, 1], own[:, 0]))]
        return pa.Table.from_batches([filled(b, own) for b in left.combine_chunks().to_batches()]) if len(left) else pa.table({f.name: pa.array([], f.type) for f in left.schema if f.name in names} | {"sequence_id": pa.array([], pa.int64()), "offset": pa.array([], pa.int64())})

    blocked = ranked.withColumn("block", (F.col("rank") / block).cast("long"))
    return blocked.groupBy("length", "block").cogroup(wide.groupBy("length", "block")).applyInArrow(look_up_group, fields)


def pack(df: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pack all rows into sequences of at most `capacity` tokens.

    One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.
    Repeated rows and equal ids are packed like any others.  The pieces (not
    their ids) are written once, so that ranks do not change if a task runs again.
    """
    return assign(written(cut(df, path, end_id, capacity, text_col, id_col), "pieces"), capacity)
