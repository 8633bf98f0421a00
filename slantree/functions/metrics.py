"""Evaluation metrics over (y, prediction, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slantree.functions import analysis
from slantree.operators import ordered


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """y, support, recall, precision, specificity, f1 of each class that occurs as a label; 0 where undefined."""
    cells = confusion(df, y, pred)
    labels = cells.select(F.explode(F.array(F.struct(F.col("y").alias("k"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("k"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp")))).alias("s")).select("s.*")
    sums = labels.groupBy("k").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    total = F.sum("support").over(W.partitionBy())  # one row per class
    out = sums.withColumn("total", total).where("support > 0")
    recall = F.col("tp") / F.col("support")
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    negatives = F.col("total") - F.col("support")
    specificity = F.when(negatives > 0, (negatives - (F.col("predicted") - F.col("tp"))) / negatives).otherwise(0.0)
    return out.select(F.col("k").alias("y"), "support", recall.alias("recall"), precision.alias("precision"), specificity.alias("specificity"), (2 * F.col("tp") / (F.col("support") + F.col("predicted"))).alias("f1"))


def summary(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """accuracy, balanced_accuracy, specificity_macro, f1_macro, f1_weighted."""
    c = per_class(df, y, pred)
    return c.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("specificity").alias("specificity_macro"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) != 1).cast("long")).alias("q"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """By rank sums over distinct scores; ties count half."""
    steps = ordered.running(_by_score(df, y, score), "s", ["q"])
    wins = steps.withColumn("wins", F.col("p") * (F.col("run_q") - F.col("q") / 2.0))
    return wins.agg((F.sum("wins") / (F.sum("p").cast("double") * F.sum("q"))).alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    steps = ordered.running(_by_score(df, y, score), "s", ["p", "q"], descending=True)
    steps = steps.select("p", (F.col("run_p") / (F.col("run_p") + F.col("run_q"))).alias("precision"))
    return steps.agg((F.sum(F.col("p") * F.col("precision")) / F.sum("p")).alias("average_precision"))


def one_vs_rest(df: DataFrame, classes: int, metric, y: str = "y", probability: str = "probability") -> DataFrame:
    """y, value: a binary metric of each class against the rest; its mean is the macro metric."""
    parts = [metric(df.select((F.col(y) == c).cast("int").alias("y"), F.col(probability)[c].alias("score"))).toDF("value").select(F.lit(c).alias("y"), "value") for c in range(classes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def clipped(probability: str, clip: float = 1e-7):
    """Probabilities kept within clip..1 - clip and scaled to sum to 1 again."""
    inner = F.transform(probability, lambda p: F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip)))
    return F.transform(inner, lambda p: p / F.aggregate(inner, F.lit(0.0), lambda s, x: s + x))


def multi_log_loss(df: DataFrame, y: str = "y", probability: str = "probability", clip: float = 1e-7) -> DataFrame:
    rows = df.select(F.col(y).cast("int").alias("y"), clipped(probability, clip).alias("p"))
    return rows.agg(F.avg(-F.log(F.element_at("p", F.col("y") + 1))).alias("log_loss"))


def log_loss(df: DataFrame, y: str, p1: str, clip: float = 1e-7) -> DataFrame:
    p = F.least(F.greatest(F.col(p1), F.lit(clip)), F.lit(1 - clip))
    return df.agg(F.avg(F.when(F.col(y) == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson, and Spearman over mean ranks taken from counts per distinct value; rows without both values do not count.

    Rows are counted by pairs of values first, so a frequent value is joined
    once for each value that it stands beside.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = rows.groupBy(a, b).agg(F.count("*").alias("_n"))
    both = pairs.join(ordered.ranks(rows, a, "_rank_a"), a).join(ordered.ranks(rows, b, "_rank_b"), b)
    x, y, n = F.col("_rank_a"), F.col("_rank_b"), F.col("_n")
    sums = both.agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    top = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    spread = (F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n"))
    spearman = sums.select(F.try_divide(top, F.sqrt(spread)).alias("spearman"))
    return rows.agg(F.corr(a, b).alias("pearson")).join(F.broadcast(spearman))  # one row each


def staged(scores: DataFrame, loss, row: str = "row_id", tree: str = "tree_id", value: str = "value", init: float = 0.0) -> DataFrame:
    """tree, loss after that tree: `scores` has a row per row and tree with the tree's contribution; `loss` maps the score so far to a column."""
    so_far = F.sum(value).over(W.partitionBy(row).orderBy(tree).rowsBetween(W.unboundedPreceding, 0)) + init
    return scores.withColumn("_f", so_far).groupBy(tree).agg(F.avg(loss(F.col("_f"))).alias("loss"))


def staged_values(rows: DataFrame, loss, row: str = "row_id", values: str = "values", tree: str = "tree_id", init: float = 0.0) -> DataFrame:
    """`staged` where each row holds its trees' contributions as an array, numbered from 0: only a hash of the rows is shuffled.

    Rows of one `row` add up as they do in `staged`, which takes over where any repeat.
    """
    if analysis.repeats(rows.select(row), row) is not None:
        return staged(rows.select("*", F.posexplode(values).alias(tree, "_v")), loss, row, tree, "_v", init)

    def added(sums, v):
        before = F.try_element_at(sums, F.lit(-1))
        return F.concat(sums, F.array(F.coalesce(before + v, before, v)))

    so_far = F.aggregate(F.col(values).cast("array<double>"), F.array().cast("array<double>"), added)
    each = rows.select("*", F.posexplode(so_far).alias(tree, "_f")).withColumn("_f", F.col("_f") + init)
    return each.groupBy(tree).agg(F.avg(loss(F.col("_f"))).alias("loss"))


def stopping_round(losses: DataFrame, patience: int, tree: str = "tree_id", loss: str = "loss") -> DataFrame:
    """best_round and stop_round (null: patience never ran out) of a table of one loss per round."""
    until = W.orderBy(tree).rowsBetween(W.unboundedPreceding, 0)  # one row per round
    marked = losses.withColumn("_best", F.min(F.struct(loss, tree)).over(until)[tree])
    stop = F.min(F.when(F.col(tree) - F.col("_best") >= patience, F.col(tree)))
    stops = marked.agg(stop.alias("stop_round"))
    open_ = marked.join(F.broadcast(stops), F.col("stop_round").isNull() | (F.col(tree) <= F.col("stop_round")))
    return open_.groupBy("stop_round").agg(F.max("_best").alias("best_round")).select("best_round", "stop_round")
