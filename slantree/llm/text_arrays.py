"""Column-at-a-time text primitives used inside Spark tasks.

A batch of strings is one contiguous UTF-8 buffer plus offsets (Arrow's own
layout).  The helpers below find words and lines of the whole buffer at once
and hash them with a prefix-sum polynomial hash, so that per-document Python
loops stay out of the hot path.  Every byte that separates words is ASCII, so
working on bytes is the same as working on code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Word separators of the contracts: space, tab, LF, VT, FF, CR.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that continue a UTF-8 character.
CONTINUES = np.zeros(256, dtype=bool)
CONTINUES[0x80:0xC0] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
#: Texts are hashed strip by strip: working memory does not follow the length of a text.
STRIP = 1 << 15


def _powers(base: int) -> np.ndarray:
    steps = np.full(STRIP, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)
_NEXT, _BACK = (np.array([pow(base, STRIP, 2**64)], np.uint64) for base in (_BASE, _INVERSE))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Freed memory goes back to the system: Python workers live on between tasks and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class TextBatch:
    """Words, lines and hashes of a batch of texts; a null text counts as empty."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        self.n = n
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = int(offsets[0]) if n else 0
        self.bytes = raw[first : int(offsets[-1]) if n else 0]
        if lower:
            self.bytes = LOWER[self.bytes]
        self.start, self.end = offsets[:-1] - first, offsets[1:] - first

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        return self.between(flags, self.start, self.end)

    @staticmethod
    def between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(flags)
        return np.searchsorted(at, end) - np.searchsorted(at, start)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each word, in reading order."""
        inside = ~SPACE[self.bytes]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        full = self.end > self.start
        at = self.start[full]
        opens[at] |= inside[at]
        at = self.end[full] - 1
        closes[at] |= inside[at]
        start = np.flatnonzero(opens)
        return start, np.flatnonzero(closes) + 1, np.searchsorted(self.start, start, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line between newlines; an empty text has one empty line."""
        breaks = np.flatnonzero(self.bytes == 10)
        start = np.concatenate([self.start, breaks + 1])
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.start, breaks, "right") - 1])
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        end[last] = self.end[doc[last]]
        return start, end, doc

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch of bytes, given in reading order; equal bytes, equal hash.

        The stretches' sums are differences of one running sum over the buffer,
        of which only a strip is held at a time.
        """
        first, last = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
        total, power, inverse = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
        sums = np.empty(STRIP + 1, np.uint64)
        back = np.empty(len(start), np.uint64)
        size = len(self.bytes)
        i = j = 0
        for at in range(0, size + 1, STRIP):
            part = self.bytes[at : at + STRIP]
            terms = _BYTE[part]
            terms *= _POWERS[: len(part)]
            terms *= power
            sums[0] = total[0]
            np.cumsum(terms, out=sums[1 : len(part) + 1])
            sums[1 : len(part) + 1] += total
            # A stretch's ends are read off in the strip that they fall into.
            k, m = np.searchsorted(start, at + STRIP), np.searchsorted(end, at + STRIP)
            here = start[i:k] - at
            first[i:k], back[i:k] = sums[here], _INVERSES[here] * inverse
            last[j:m] = sums[end[j:m] - at]
            i, j = k, m
            total, power, inverse = sums[len(part) : len(part) + 1].copy(), power * _NEXT, inverse * _BACK
        return mix((last - first) * back + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of one document, and where each starts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = mix(out + hashes[at + k] * np.uint64(2 * k + 3))
    return out, at


def slices(batches: Iterator[pa.RecordBatch], column: str, target: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that the text of each is about `target` bytes at most; a longer text stands alone."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths)
        at = 0
        while at < len(batch):
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + target, "right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


def pieces(texts: pa.Array, target: int = 1 << 19) -> Iterator[pa.Array]:
    """The same cut for one array; at least one piece, so that empty input keeps its type."""
    table = pa.record_batch([texts], ["t"])
    yield from (b.column(0) for b in slices(iter([table]), "t", target))
    if not len(texts):
        yield texts
