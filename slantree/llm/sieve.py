"""Bit maps that keep most unwanted rows out of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits of a map at least and at most (32 MB).  A map that fills up lets more rows through and never fewer; only the join decides.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def bits_for(n: int, each: int = 16) -> int:
    """A power of two of about `each` bits an id, within the limits."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, n) * each - 1).bit_length()))


def on(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the map may hold each value (of 64 random bits)."""
    at = (values.view(np.uint64) & np.uint64(len(words) * 64 - 1)).astype(np.int64)
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def bit_map(wanted: DataFrame, value: Column, bits: int | None = None):
    """Broadcast words of a map, set where the low bits of `value` (64 random bits) fall."""
    bits = bits_for(wanted.count()) if bits is None else bits
    place = value.bitwiseAND(F.lit(bits - 1))
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    got = words.toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return wanted.sparkSession.sparkContext.broadcast(out)


def held_in(sent, value: Column, wanted_in: bool = True) -> Column:
    """Whether a broadcast map may hold `value` (not null); with wanted_in=False, whether it surely does not."""

    @F.arrow_udf(BooleanType())
    def held(p: pa.Array) -> pa.Array:
        return pa.array(on(sent.value, np.ascontiguousarray(p.to_numpy(zero_copy_only=False)).astype(np.int64)) == wanted_in)

    return held(value)


def sieve(df: DataFrame, id_col: str, wanted: DataFrame, wanted_col: str, bits: int | None = None, wanted_in: bool = True) -> DataFrame:
    """Rows of `df` whose id may be among `wanted`: all that are, and few others.  A join must follow.

    With wanted_in=False, the other rows: none of theirs is among `wanted`.
    """
    sent = bit_map(wanted, F.xxhash64(F.col(wanted_col)), bits)
    return df.where(held_in(sent, F.xxhash64(F.col(id_col)), wanted_in))
