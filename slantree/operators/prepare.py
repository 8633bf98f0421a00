"""Feature preparation: statistics, bins, imputation, dictionaries, ranks, rotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantree.operators import ordered

EPS = 1e-8


def melt(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, f, x: one row per feature value; a narrow transformation."""
    pairs = F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).cast("double").alias("x")) for k, c in enumerate(cols)])
    return df.select(*keys, F.inline(pairs))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """f, lo, hi, n, mean (sum / (n + eps)) and whether the feature varies; one pass, NULL and NaN skipped."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    sums = [F.struct(F.lit(k).alias("f"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), (F.sum(v) / (F.count(v) + EPS)).alias("mean")) for k, v in enumerate(clean.values())]
    return df.agg(F.array(*sums).alias("s")).select(F.inline("s")).withColumn("active", F.coalesce(F.col("hi") - F.col("lo") > 1e-12, F.lit(False)))


def bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin 0..bins-2; a missing value has bin bins-1."""
    width = (bins - 1) / (hi - lo + EPS)
    b = F.least(F.lit(bins - 2), F.greatest(F.lit(0), F.floor((x - F.lit(lo)) * F.lit(width)))).cast("int")
    return F.when(x.isNull() | F.isnan(x), F.lit(bins - 1)).otherwise(b)


def impute(df: DataFrame, cols: Sequence[str], values: dict[str, float], flags: bool = True) -> DataFrame:
    """Missing values replaced; with `flags`, a column <name>_missing for each."""
    missing = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in cols}
    out = df.withColumns({f"{c}_missing": m for c, m in missing.items()}) if flags else df
    return out.withColumns({c: F.when(missing[c], F.lit(values[c])).otherwise(F.col(c)) for c in cols})


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """value, id: distinct non-null values numbered in sorted order.  The reserved id for the rest is the count."""
    return ordered.numbered(df.select(F.col(f"`{col}`").alias("value")).where("value is not null").distinct(), ["value"], "id")


def encode(df: DataFrame, col: str, values: DataFrame, into: str, card: int | None = None) -> DataFrame:
    """Dictionary lookup; null and unseen values get the reserved id (the number of values).  Other columns stay, whatever their names."""
    card = values.count() if card is None else card
    known = values.select(F.col("value").alias("_value"), F.col("id").alias("_code"))
    own = [F.col(f"`{c}`") for c in df.columns if c != into]
    return df.join(known, F.col(f"`{col}`") == F.col("_value"), "left").select(*own, F.coalesce("_code", F.lit(card)).cast("int").alias(into))


def category_ranks(df: DataFrame, cat: str, g: str, h: str, reg_lambda: float = 1.0) -> DataFrame:
    """cat, score = sum(g) / (sum(h) + lambda + eps), and rank 0.. by (score, cat)."""
    scores = df.groupBy(cat).agg((F.sum(g) / (F.sum(h) + reg_lambda + EPS)).alias("score"))
    return ordered.numbered(scores, ["score", cat], "rank")


def rotate(df: DataFrame, cols: Sequence[str], matrix: Sequence[Sequence[float]], prefix: str = "r") -> DataFrame:
    """X @ R as column expressions: no shuffle."""
    return df.withColumns({f"{prefix}{j}": sum((F.col(c) * F.lit(float(matrix[i][j])) for i, c in enumerate(cols)), F.lit(0.0)) for j in range(len(matrix[0]))})


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_pop(c).alias(f"{c}_s") for c in cols]).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"{c}_m"])) / F.lit(stats[f"{c}_s"] or 1.0) for c in cols})


def blended_rotation(matrix: Sequence[Sequence[float]], strength: float) -> list[list[float]]:
    """(1 - strength) I + strength Q."""
    return [[(1 - strength) * (i == j) + strength * q for j, q in enumerate(row)] for i, row in enumerate(matrix)]


def inject_missing(df: DataFrame, cols: Sequence[str], key: str, share: float, stream: str = "miss") -> DataFrame:
    """A reproducible share of each column's values becomes null."""
    from slantree.operators.gradients import uniform

    return df.withColumns({c: F.when(uniform(F.col(key).cast("string"), f"{stream}{c}") < share, None).otherwise(F.col(c)) for c in cols})


def hashed_categories(df: DataFrame, key: str, cards: Sequence[int], stream: str = "card") -> DataFrame:
    """Categories c<card> of each cardinality from a hash of the row's key."""
    from slantree.operators.gradients import uniform

    return df.withColumns({f"c{card}": F.floor(uniform(F.col(key).cast("string"), f"{stream}{card}") * card).cast("int") for card in cards})


def made_table(spark, n: int, features: int, informative: int, seed: int = 42) -> DataFrame:
    """A made-up classification table: row_id, f0.. (normal), y from an oblique rule over the first `informative` features."""
    rows = spark.range(n).select(F.col("id").alias("row_id"), *[F.randn(seed + j).alias(f"f{j}") for j in range(features)])
    rule = sum((F.col(f"f{j}") * F.lit((-1.0) ** j / (j + 1)) for j in range(informative)), F.lit(0.0))
    return rows.withColumn("y", (rule > 0).cast("int"))
