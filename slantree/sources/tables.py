"""Readers and writers of tables, parameters and results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, header: bool = True, index: str | None = None, limit: int | None = None, pattern: str | None = None) -> DataFrame:
    """CSV (plain or gzip) with inferred types; several files union, of a folder those whose names fit `pattern`.  An index column is dropped."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    df = reader.csv(path, header=header, inferSchema=True)
    df = df.drop(index) if index else df
    return df.limit(limit) if limit is not None else df


def read_params(spark: SparkSession, path: str, section: str) -> dict:
    """A section of a JSON parameter file; empty if the section is absent."""
    row = spark.read.json(path, multiLine=True)
    if section not in row.columns:
        return {}
    value = row.select(F.col(section)).first()[0]
    return {k: v for k, v in value.asDict(recursive=True).items() if v is not None} if value is not None else {}


def write_params(params: dict, path: str, spark: SparkSession) -> None:
    """One JSON object, as read_params reads it."""
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: Columns of a gain log: a row per candidate of a searched node.
GAIN_LOG = "tree_id int, node_seq int, depth int, ns long, family string, gain double"


def write_gain_log(df: DataFrame, path: str) -> None:
    """CSV with a header, as read_gain_log reads it."""
    df.write.mode("overwrite").csv(path, header=True)


def read_gain_log(spark: SparkSession, path: str) -> DataFrame:
    """node_seq, depth, ns (and tree_id where logged), gains: a node's candidate gains by family."""
    log = read_csv(spark, path)
    node = [c for c in ("tree_id", "node_seq", "depth", "ns") if c in log.columns]
    lists = log.groupBy(*node, "family").agg(F.sort_array(F.collect_list(F.col("gain").cast("double"))).alias("gains"))
    return lists.groupBy(*node).agg(F.map_from_entries(F.collect_list(F.struct("family", "gains"))).alias("gains"))


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, keys: list[str], metrics: list[str]) -> str:
    """mean±std per key as a Markdown table; a summary, so small."""
    aggs = [F.concat(F.format_number(F.avg(m), 4), F.lit("±"), F.format_number(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 4)).alias(m) for m in metrics]
    rows = df.groupBy(*keys).agg(*aggs).orderBy(*keys).collect()
    head = [*keys, *metrics]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(v) for v in row) + " |" for row in rows)])


def summary_lines(df: DataFrame, key: str, metric: str) -> list[str]:
    """A line of statistics per key."""
    rows = df.groupBy(key).agg(F.avg(metric).alias("mean"), F.max(metric).alias("best"), F.min(metric).alias("worst"), F.count("*").alias("n")).orderBy(key).collect()
    return [f"{r[key]}: mean {r['mean']:.4f}, best {r['best']:.4f}, worst {r['worst']:.4f}, n {r['n']}" for r in rows]
