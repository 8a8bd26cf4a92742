"""Model metrics computed from a table of labels and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import settle

RANGE_SCORES = 100_000
"""Distinct scores per value range, about; the number of ranges grows with them."""


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)``, as many rows as there are pairs of classes."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    df: DataFrame, classes: Sequence, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return (
        df.groupBy(F.col(label).alias("label"))
        .pivot(prediction, list(classes))
        .count()
        .na.fill(0)
    )


def class_metrics(counts: DataFrame) -> DataFrame:
    """``(class, support, predicted, hits, precision, recall, f1_score)``; 0 where undefined."""
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("h")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("t"),
                         F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")),
            )
        )
    )
    totals = sides.groupBy("class").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return totals.withColumns(
        {
            "precision": ratio(F.col("hits"), F.col("predicted")),
            "recall": ratio(F.col("hits"), F.col("support")),
            "f1_score": ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")),
        }
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1: of class 1 for two classes, else weighted by support."""
    per_class = class_metrics(confusion_counts(df, label, prediction))
    two = F.count_if(F.col("support") > 0) == 2
    total = F.sum("support")

    def pick(name: str) -> Column:
        weighted = F.sum(F.col(name) * F.col("support")) / total
        return F.when(two, F.coalesce(F.max(F.when(F.col("class") == 1, F.col(name))), F.lit(0.0))).otherwise(weighted)

    return per_class.agg(
        (F.sum("hits") / total).alias("accuracy"),
        *[pick(n).alias(n) for n in ("precision", "recall", "f1_score")],
    )


def roc_auc(df: DataFrame, positive: Column, score: Column, group: Column | None = None) -> DataFrame:
    """Exact rank-sum ROC-AUC per group, ties counted half.

    Scores collapse to counts first.  The distinct scores are then dealt into value
    ranges, whose number grows with them, so the running count of negatives is a
    window inside a range plus an offset from a table with one row per range.
    """
    counts = settle(
        df.select(
            (F.lit(0) if group is None else group).alias("g"),
            score.cast("double").alias("s"),
            positive.cast("boolean").alias("is_pos"),
        )
        .groupBy("g", "s")
        .agg(F.count_if("is_pos").alias("pos"), F.count_if(~F.col("is_pos")).alias("neg"))
    )
    ranges = 1 + counts.count() // RANGE_SCORES
    ranged = settle(counts.repartitionByRange(ranges, "g", "s").withColumn("b", F.spark_partition_id()))
    ordered = Window.partitionBy("g").orderBy("b")
    offsets = (
        ranged.groupBy("g", "b")
        .agg(F.sum("neg").alias("in_range"))
        .select("g", "b", (F.sum("in_range").over(ordered) - F.col("in_range")).alias("before"))
    )
    inside = Window.partitionBy("g", "b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    below = F.col("before") + F.sum("neg").over(inside) - F.col("neg")
    wins = F.col("pos").cast("double") * (below + F.col("neg") / 2)  # the product outgrows a bigint
    won = ranged.join(offsets, ["g", "b"]).select("g", "pos", "neg", wins.alias("wins"))
    totals = won.groupBy("g").agg(F.sum("wins").alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    pairs = F.col("p").cast("double") * F.col("n")
    return totals.select("g", (F.col("wins") / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def roc_auc_binary(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return roc_auc(df, F.col(label) == 1, F.col(score)).select("roc_auc")


def roc_auc_one_vs_rest(df: DataFrame, label: str, scores: str, classes: int) -> DataFrame:
    """Mean AUC of each class against the rest; null when a class is absent."""
    long = df.select(F.col(label).alias("y"), F.posexplode(scores).alias("c", "s"))
    per_class = roc_auc(long, F.col("y") == F.col("c"), F.col("s"), F.col("c"))
    return per_class.agg(
        F.when(F.count("roc_auc") == classes, F.avg("roc_auc")).alias("roc_auc")
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R2, MSE, MAE and RMSE from one pass."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mean_absolute_error"),
        F.var_pop(y).alias("spread"),
    ).select(
        (1 - F.col("mse") / F.nullif(F.col("spread"), F.lit(0.0))).alias("r2_score"),
        F.col("mse").alias("mean_squared_error"),
        "mean_absolute_error",
        F.sqrt("mse").alias("root_mean_squared_error"),
    )


def fold_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"))
