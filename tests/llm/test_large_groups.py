"""Large candidate groups: hubs first, then what is still open; against brute force, and the work that is left."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantree.llm import near_dedup
from tests.llm.test_operators import brute_groups


@pytest.fixture(scope="module")
def chained():
    """Near copies of a text, a chain of texts that drift away from it, short ones, and strangers."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(4000)]
    base = list(rng.choice(words, 120))
    rows = []
    for k in range(150):
        own = list(base)
        own[int(rng.integers(120))] = f"x{k}"
        rows.append(own)
    drift = list(base)
    for k in range(60):
        drift = list(drift)
        drift[2 * k % 120] = f"y{k}"
        rows.append(drift)
    rows += [base[:30], base[:31], base + [f"z{k}" for k in range(14)]]
    rows += [list(rng.choice(words, 50)) for _ in range(20)]
    return [(k, " ".join(t)) for k, t in enumerate(rows)]


@pytest.mark.parametrize("block", [5, 40, 1500])
def test_groups_of_any_block_size(spark, chained, block):
    df = spark.createDataFrame(chained, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, percent=85, size=3, block_members=block).collect()}
    assert got == brute_groups(chained, 85, 3)


def test_copies_cost_as_much_as_they_are(spark):
    """Members of one class are not compared with each other: units hold each of them a bounded number of times."""
    n = 10_000
    members = spark.range(n).select("id", F.lit(1).cast("long").alias("grp"), F.lit(100).cast("long").alias("n_shingles"), F.col("id").alias("doc_id"), F.col("id").alias("text_hash")).repartition(4)
    links = spark.range(1, n - 20).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    units = near_dedup.open_units(members, links, 80, 500, 1_000_000)
    assert units.groupBy("id").count().agg(F.max("count")).first()[0] <= n // 500 + 2, "the 20 open ones meet every block of the class"
    assert units.where(f"id < {n - 20}").groupBy("id").count().where("count > 1").count() == 0
    assert units.where("i = j").select("id").distinct().count() == 20
    none = near_dedup.open_units(members, spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")), 80, 500, 1_000_000)
    assert none.count() == 0


def test_blocks_of_unlike_sizes_do_not_meet(spark):
    members = spark.createDataFrame([(k, 1, 10 * 4**k, k, k) for k in range(6)], "id long, grp long, n_shingles long, doc_id long, text_hash long")
    units = near_dedup.open_units(members, spark.createDataFrame([], "a long, b long"), 80, 1, 10**9)
    assert units.where("i <> j").count() == 0 and units.count() == 6
