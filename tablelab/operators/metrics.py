"""Classification metrics for every split at once, from one confusion matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab import SPLIT, messages
from tablelab.functions import argmax

CLASSIFICATION_METRICS = ("Accuracy", "Precision", "Recall", "F1", "BalancedAccuracy")

# Direction of each metric: whether a search should look for its largest value.
MAXIMIZE = {
    "Accuracy": True,
    "Precision": True,
    "Recall": True,
    "F1": True,
    "BalancedAccuracy": True,
    "Bleu": True,
    "Ter": False,
}


def with_predicted_class(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Add ``prediction``: the class with the largest probability."""
    return df.withColumn("prediction", argmax(probability).cast("double"))


def confusion_matrix(
    df: DataFrame, label: str, prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Rows per (group, true class, predicted class): the only pass over the data."""
    by = [SPLIT] if by is None else by
    return df.groupBy(*by, F.col(label).alias("y"), F.col(prediction).alias("yhat")).agg(
        F.count("*").alias("n")
    )


def scores_from_confusion(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and balanced accuracy per group.

    With more than two true classes the scores are macro means over the classes seen in the truth
    or among the predictions; otherwise they are those of class 1. An empty ratio counts as 0.
    """
    by = [SPLIT] if by is None else by
    sides = F.explode(
        F.array(
            F.struct(F.col("y").alias("c"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("said")),
            F.struct(F.col("yhat").alias("c"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("said")),
        )
    ).alias("side")
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)
    per_class = (
        matrix.select(*by, hit.alias("hit"), sides)
        .groupBy(*by, F.col("side.c").alias("c"))
        .agg(
            # a hit shows up on both of its sides
            (F.sum("hit") / 2).alias("tp"),
            F.sum("side.truth").alias("truth"),
            F.sum("side.said").alias("said"),
        )
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, truth, said = F.col("tp"), F.col("truth"), F.col("said")
    scored = per_class.select(
        *by,
        "c",
        "truth",
        "tp",
        ratio(tp, said).alias("p"),
        ratio(tp, truth).alias("r"),
        ratio(2 * tp, truth + said).alias("f"),
    )
    many = F.count_if(F.col("truth") > 0) > 2
    positive = lambda c: F.coalesce(F.max(F.when(F.col("c") == 1, F.col(c))), F.lit(0.0))
    either = lambda c: F.when(many, F.avg(c)).otherwise(positive(c))
    return scored.groupBy(*by).agg(
        (F.sum("tp") / F.sum("truth")).alias("Accuracy"),
        either("p").alias("Precision"),
        either("r").alias("Recall"),
        either("f").alias("F1"),
        F.avg(F.when(F.col("truth") > 0, F.col("r"))).alias("BalancedAccuracy"),
    )


def classification_scores(
    df: DataFrame, label: str, prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """All classification metrics for every group (by default every split) in one pass."""
    return scores_from_confusion(confusion_matrix(df, label, prediction, by), by)


def scores_long(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per group and metric."""
    by = [SPLIT] if by is None else by
    metrics = [c for c in scores.columns if c not in by]
    return scores.unpivot(by, metrics, "metric", "value")


def check_lengths(truth: DataFrame, predicted: DataFrame) -> None:
    """Two separate result tables must have the same number of rows."""
    a, b = truth.count(), predicted.count()
    if a != b:
        raise ValueError(messages.LENGTHS.format(truth=a, predicted=b))
