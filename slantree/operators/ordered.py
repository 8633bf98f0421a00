"""Ranks, running sums, quantiles and cuts over whole tables, without a task that sees all rows.

Values are dealt into PARTS ranges by approximate quantiles, a fixed function
of the value, so that recomputed partitions agree and equal values stay
together.  Sums per range are few; within a range a window runs on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType
from pyspark.sql.window import Window as W

from slantree.sources.folders import written

#: Ranges that a table is dealt into.
PARTS = 64
#: Rows of a task where the number of tasks follows the rows.
ROWS_A_TASK = 200_000


def parts_for(rows: DataFrame) -> int:
    """How many parts a shuffle of these rows asks for: a task's memory then stays the same however many they are."""
    return rows.count() // ROWS_A_TASK + 1


def part_of(df: DataFrame, value: str, parts: int = PARTS) -> Column:
    """The range of each row by `value`, a numeric column; ranges ascend with it."""
    edges = sorted(set(df.select(value).where(F.col(value).isNotNull()).approxQuantile(value, [k / parts for k in range(1, parts)], 0.5 / parts)))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(value) <= F.lit(edges[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(edges)) if edges else F.lit(0)


def numbered(df: DataFrame, by: Sequence[str], into: str) -> DataFrame:
    """`df` with its rows numbered from 0 in the order of `by`, range by range: no task sorts all rows.

    Rows are dealt into ranges and written with their place in them once, so
    that counts and places are of the same ranges.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    held, _ = written(placed)
    part = F.shiftright("_at", 33)
    counts = held.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    numbers = held.withColumn("_range", part).join(F.broadcast(offsets), "_range")
    return numbers.withColumn(into, (F.col("_o") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).select(*df.columns, into)


def running(df: DataFrame, value: str, sums: Sequence[str], descending: bool = False, parts: int = PARTS) -> DataFrame:
    """`df` with run_<c>, the sum of each column over all rows up to and including this one in the order of `value`.

    Rows of equal value count as they come: aggregate by value first where ties matter.
    """
    placed = df.withColumn("_part", part_of(df, value, parts))
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    order = F.desc("_part") if descending else F.asc("_part")
    before = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)  # PARTS rows
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    within = W.partitionBy("_part").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "_part").withColumns({f"run_{c}": F.sum(c).over(within) + F.col(f"_o_{c}") for c in sums})
    return out.drop("_part", *[f"_o_{c}" for c in sums])


def running_by(df: DataFrame, keys: Sequence[str], part: str, value: str, sums: Sequence[str]) -> DataFrame:
    """run_<c> for many lists at once: sums over a list's rows up to this one in the order of `value`, and next_<value>, the following value.

    A list is the rows equal in `keys`; `part` numbers ranges that ascend with
    the value, so a list is summed range by range and the ranges' totals, which
    are few, are added on.  Values of a list are distinct.
    """
    totals = df.groupBy(*keys, part).agg(F.min(value).alias("_first"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    order = W.partitionBy(*keys).orderBy(part)  # as many rows as ranges
    before = order.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, part, F.lead("_first").over(order).alias("_then"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    within = W.partitionBy(*keys, part).orderBy(value)
    run = within.rowsBetween(W.unboundedPreceding, 0)
    out = df.join(offsets, [*keys, part]).withColumns({f"run_{c}": F.sum(c).over(run) + F.col(f"_o_{c}") for c in sums})
    return out.withColumn(f"next_{value}", F.coalesce(F.lead(value).over(within), F.col("_then"))).drop(part, "_then", *[f"_o_{c}" for c in sums])


def counted(df: DataFrame, value: str) -> DataFrame:
    """value, n, run_n: rows per distinct non-null value, and up to it."""
    return running(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), value, ["n"])


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; None for a table without values."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * q for q in shares]
    wanted = sorted({int(a) for a in at} | {min(n - 1, int(a) + 1) for a in at})
    runs = counted(df, value)
    row = runs.agg(*[F.min(F.when(F.col("run_n") > k, F.col(value))).alias(f"v{k}") for k in wanted]).first()
    return [float(row[f"v{int(a)}"]) + (a - int(a)) * (float(row[f"v{min(n - 1, int(a) + 1)}"]) - float(row[f"v{int(a)}"])) for a in at]


#: Bins of one pass over the rows in a search for a cut, and rows below which they are sorted instead.
BINS, SMALL = 1 << 16, 100_000


def text_number(key: Column, at: int) -> Column:
    """Bytes `at` to `at` + 5 (from 0) of a text as a number: ascends with the text where the bytes before are equal."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), at + 1, 6)), 12, "0"), 16, 10).cast("double")


def digits_of(df: DataFrame, value: str, key: str, descending: bool) -> list[Column]:
    """Numbers whose order, one after the other, is that of the rows: the value, then the key, then a hash of the whole row.

    A value that is null or NaN comes last, a null key after the others.
    """
    last = F.lit(float("inf"))
    v = F.col(value).cast("double")
    v = F.coalesce(F.nanvl(-v if descending else v, last), last)
    own = F.col(key)
    if isinstance(df.schema[key].dataType, IntegralType):
        whole = own.cast("long")
        keys = [F.coalesce(F.shiftright(whole, 32).cast("double"), last), F.coalesce(whole.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"), last)]
    elif isinstance(df.schema[key].dataType, NumericType):
        keys = [F.coalesce(F.nanvl(own.cast("double"), last), last)]
    else:
        text = own.cast("string")
        longest = df.agg(F.max(F.octet_length(text))).first()[0] or 0
        keys = [F.coalesce(text_number(text, at), last) for at in range(0, max(1, longest), 6)]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return [v, *keys, F.shiftright(row, 32).cast("double"), row.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")]


def cut_at(rows: DataFrame, digit: str, k: int, small: int = SMALL) -> tuple[float, int, int]:
    """The k-th smallest value of a column without nulls, how many rows are below it, and how many have it.

    Each pass counts rows in BINS equal widths and goes on in the one that holds
    the k-th row; few rows, or rows of one value, end the search.
    """
    below, inside = 0, rows
    while True:
        lo, hi, n = inside.agg(F.min(digit), F.max(digit), F.count("*")).first()
        if lo == hi:
            return lo, below, n
        if n <= small or not math.isfinite(hi - lo):
            break
        width = (hi - lo) / BINS
        place = F.least(F.lit(BINS - 1), F.floor((F.col(digit) - F.lit(lo)) / F.lit(width))).cast("int")
        counts = sorted((r["b"], r["count"]) for r in inside.groupBy(place.alias("b")).count().collect())  # BINS rows at most
        for b, count in counts:
            if below + count >= k:
                break
            below += count
        inside = inside.where(place == b)
    if n > small:  # infinite values among the others: they come last
        finite = inside.where(F.col(digit) < F.lit(float("inf")))
        m = finite.count()
        if below + m < k:
            return float("inf"), below + m, n - m
        return tuple(a + b for a, b in zip((0, below, 0), cut_at(finite, digit, k - below, small)))
    cut = inside.select(digit).orderBy(digit).limit(k - below).agg(F.max(digit)).first()[0]
    less, same = inside.agg(F.count(F.when(F.col(digit) < F.lit(cut), 1)), F.count(F.when(F.col(digit) == F.lit(cut), 1))).first()
    return cut, below + less, same


def first_n(df: DataFrame, n: int, value: str, key: str, descending: bool = False, total: int | None = None, small: int = SMALL) -> Column:
    """Whether a row is among the n first by `value` (a number), ties by `key`, then by a hash of the row.

    The cut is found number by number, in counts over bins: no task sees more
    than `small` rows, however many tie.  Rows equal in all columns share their
    fate, so only such rows can make it more than n.
    """
    if n <= 0:
        return F.lit(False)
    if n >= (df.count() if total is None else total):
        return F.lit(True)
    digits = digits_of(df, value, key, descending)
    names = [f"d{k}" for k in range(len(digits))]
    rows = df.select(*[d.alias(c) for d, c in zip(digits, names)]).persist()
    cuts, left, short = [], rows, n
    for name in names:
        cut, below, same = cut_at(left, name, short, small)
        cuts.append(cut)
        short -= below
        if short == same:
            break
        left = left.where(F.col(name) == F.lit(cut))
    rows.unpersist()
    inside = digits[len(cuts) - 1] <= F.lit(cuts[-1])
    for digit, cut in list(zip(digits, cuts))[-2::-1]:
        inside = (digit < F.lit(cut)) | ((digit == F.lit(cut)) & inside)
    return inside


def ranks(df: DataFrame, value: str, into: str) -> DataFrame:
    """value and its mean rank from 1, as ties share it."""
    return counted(df, value).select(value, (F.col("run_n") - (F.col("n") - 1) / 2.0).alias(into))
