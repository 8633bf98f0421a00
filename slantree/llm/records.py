"""Records of numbers shuffled as packed columns.

A row of the shuffle holds all of a task's records of one bucket, column after
column, so that Spark partitions and moves the work while the numbers stay in
numpy.  Records are dealt to buckets by a hash; a bucket is gathered whole, so
the number of buckets must follow the number of records (`buckets_for`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantree.llm.text_arrays import give_back

Columns = dict[str, np.ndarray]
#: Records that a task holds before it deals them out, or so many per bucket, if that is more.
FLUSH, FLUSH_EACH = 1 << 16, 32


def buckets_for(records: int, each: int = 200_000) -> int:
    """Buckets of about `each` records."""
    return max(1, -(-records // each))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the high half of a 64-bit hash."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack(columns: Columns) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns.values())


def unpack(blobs: Sequence[bytes], kinds: dict[str, str]) -> Columns:
    """The columns of several packed blobs, one after the other."""
    width = sum(np.dtype(k).itemsize for k in kinds.values())
    parts: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for c, kind in kinds.items():
            parts[c].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {c: np.concatenate(p) if p else np.zeros(0, kinds[c]) for c, p in parts.items()}


def dealt(columns: Columns, bucket: np.ndarray, packer: Callable[[Columns], bytes] = pack) -> pa.RecordBatch:
    """bucket, records: a row per bucket that has records."""
    order = np.argsort(bucket, kind="stable")
    columns = {c: v[order] for c, v in columns.items()}
    found, first = np.unique(bucket[order], return_index=True)
    edge = np.append(first, len(bucket))
    blobs = [packer({c: v[a:b] for c, v in columns.items()}) for a, b in zip(edge, edge[1:])]
    return pa.record_batch([pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "records"])


def deal(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[Columns]], buckets: int, key: str, merge: Callable[[Columns], Columns] | None = None, packer=pack) -> DataFrame:
    """bucket, records of what `make` yields, dealt by the hash in column `key`.

    `merge` may join records of equal keys before they are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                whole = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                held.clear()
                whole = merge(whole) if merge else whole
                yield dealt(whole, bucket_of(whole[key], buckets), packer)
                give_back()

        for columns in make(batches):
            held.append(columns)
            if sum(len(h[key]) for h in held) >= max(FLUSH, FLUSH_EACH * buckets):
                yield from flush()
        yield from flush()

    return df.mapInArrow(run, "bucket long, records binary")


def gather(sides: Sequence[DataFrame], work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`work(bucket, blobs of side 0, blobs of side 1, ...)` once per bucket."""
    rows = sides[0].withColumn("side", F.lit(0))
    for k, side in enumerate(sides[1:], 1):
        rows = rows.union(side.withColumn("side", F.lit(k)))
    n = len(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, [[] for _ in range(n)]
        for batch in batches:
            blobs = batch.column("records")
            for k, (bucket, side) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("side").to_pylist())):
                blob = blobs[k].as_py()
                if bucket != at:
                    if at is not None:
                        yield from work(at, *held)
                        give_back()
                    at, held = bucket, [[] for _ in range(n)]
                held[side].append(blob)
        if at is not None:
            yield from work(at, *held)
        give_back()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
