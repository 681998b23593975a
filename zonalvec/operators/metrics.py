"""Classification metrics from true and predicted labels (columns y and p), and bootstrap summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")


def confusion(predictions: DataFrame, *keys: str) -> DataFrame:
    return predictions.groupBy(*keys, "y", "p").agg(F.count(F.lit(1)).alias("n"))


def class_scores(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, support, tp, precision, recall, f1) for the union of true and predicted labels; 0/0 is 0."""
    cells = confusion(predictions, *keys)
    sides = F.explode(F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
                              F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))))
    both = cells.select(*keys, sides.alias("s"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    sums = both.groupBy(*keys, F.col("s.label").alias("label")).agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), (F.sum("hit") / 2).cast("long").alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return sums.select(
        *keys, "label", "support", "tp", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    """The five metrics, one row a key."""
    s = class_scores(predictions, *keys)
    return s.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
    )


def summary(by_rep: DataFrame, *keys: str, of: tuple[str, ...] = METRICS) -> DataFrame:
    """(keys, metric, mean, std, ci_lower, ci_upper) over the repetitions; the deviation is the population's."""
    long = by_rep.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in of])).alias("s")).select(*keys, "s.metric", "s.v")
    return long.groupBy(*keys, "metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", F.lit(0.025)).alias("ci_lower"), F.percentile("v", F.lit(0.975)).alias("ci_upper")
    )
