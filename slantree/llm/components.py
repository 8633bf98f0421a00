"""Connected components of a link table, as Spark joins with shrinking rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantree.llm.durable import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (smallest id reachable) of every id in `links`; ids are longs.

    Each round maps every id to the neighbour (or itself) of least hash and
    relabels the links, so that the links left shrink by a constant factor in
    expectation, whatever the shape: chains and stars too.  Minima are combined
    before the shuffle, so a hub with very many links is no hot task.  Every
    round is written, so a lost executor costs no earlier round.
    """
    links = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links0")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        salt = F.lit(len(rounds))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("m"))).alias("n"))
        moved = F.when(F.col("n.h") < F.xxhash64("a", salt), F.col("n.m")).otherwise(F.col("a"))
        step = written(least.select("a", moved.alias("to")), f"step{len(rounds)}")
        rounds.append(step)
        left = step.withColumnRenamed("to", "new_a")
        right = step.select(F.col("a").alias("b"), F.col("to").alias("new_b"))
        links = links.join(left, "a").join(right, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).where("a <> b")
        links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"links{len(rounds)}")
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = rounds[0].select(F.col("a").alias("id"), F.col("to").alias("root"))
    for step in rounds[1:]:
        found = found.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    found = written(found, "roots")
    names = found.groupBy("root").agg(F.min("id").alias("component"))
    return found.join(names, "root").select("id", "component")
