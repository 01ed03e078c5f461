"""Classifier quality from a table of (label, prediction).

Everything starts from the confusion counts: one row per pair of classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import round_half_even

GOAL = 0.80


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))


def confusion_wide(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """The square matrix: one row per true class of ``labels``, one column per predicted class."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("prediction") == p, F.col("count"))), F.lit(0)).alias(p) for p in labels
    ]
    counted = confusion(predictions).groupBy("label").agg(*cells)
    named = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    rows = predictions.sparkSession.range(1).select(named)
    filled = [F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(p) for p in labels]
    return rows.join(counted, "label", "left").select("label", *filled)


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support over the union of true and predicted classes; 0 when undefined."""
    pairs = confusion(predictions)
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("label"), F.col("count").alias("true"), F.lit(0).cast("long").alias("pred")),
                F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("true"), F.col("count").alias("pred")),
            )
        ).alias("s"),
        F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("hit"),
    )
    summed = sides.groupBy("s.label").agg(
        F.sum("s.true").alias("support"),
        F.sum("s.pred").alias("_predicted"),
        # a hit shows up on the true side and on the predicted side
        F.sum(F.when(F.col("s.true") > 0, F.col("hit")).otherwise(0)).alias("_hits"),
    )
    precision = F.coalesce(F.try_divide(F.col("_hits"), F.col("_predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("_hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("_hits"), F.col("support") + F.col("_predicted")), F.lit(0.0))
    return summed.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "_hits")


def per_class(predictions: DataFrame) -> DataFrame:
    return class_report(predictions).select(
        "label", *[round_half_even(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def summary(predictions: DataFrame) -> DataFrame:
    """One row: accuracy, macro-F1, tested rows, classes and whether the goal is met."""
    overall = class_report(predictions).agg(
        (F.sum("_hits") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.sum("support").alias("num_test"),
        F.count(F.lit(1)).alias("num_labels"),
    )
    return overall.select(
        round_half_even(F.col("accuracy"), 4).alias("accuracy"),
        round_half_even(F.col("macro_f1"), 4).alias("macro_f1"),
        "num_test",
        "num_labels",
        (F.col("macro_f1") >= GOAL).alias("goal_met"),
    )


def report_json(predictions: DataFrame, facts: dict[str, str | int | float] | None = None) -> DataFrame:
    """The metrics as one nested JSON text; per-class entries are one per class."""
    entries = per_class(predictions).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("label", F.struct("precision", "recall", "f1", "support"))))
        ).alias("m")
    )
    extra = [F.lit(v).alias(k) for k, v in (facts or {}).items()]
    body = F.struct("accuracy", "macro_f1", "num_test", "num_labels", *extra, entries.scalar().alias("per_class"))
    return summary(predictions).select(F.to_json(body).alias("value"))
