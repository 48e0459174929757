"""Classifier evaluation from confusion counts.

Everything is derived from the tiny (group, label, pred, n) count table, so
evaluating a billion predictions costs one partial+final aggregate. Macro
scores average the per-class values over a fixed class domain 0..k-1;
a zero denominator gives 0 (scikit-learn's ``zero_division=0``). MLlib's
``MulticlassClassificationEvaluator(metricName="f1")`` is the *weighted* F1,
so it is not used for the macro metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

DIGITS = 6


def confusion_counts(df: DataFrame, group: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """A20 (long form): (group..., label, pred, n)."""
    return df.groupBy(*group, F.col(label).alias("label"), F.col(pred).alias("pred")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_dense(counts: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    """One row per (group, true class) with a column per predicted class;
    every class of the domain appears, missing cells are 0."""
    dom = counts.select(*group).distinct().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    p = counts.groupBy(*group, "label").pivot("pred", list(range(k))).agg(F.sum("n"))
    out = dom.join(p, [*group, "label"], "left").na.fill(0, [str(i) for i in range(k)])
    return out.select(*group, "label", *[F.col(str(i)).cast("bigint").alias(f"pred_{i}") for i in range(k)])


def confusion_normalized(counts: DataFrame, group: list[str], digits: int = DIGITS) -> DataFrame:
    """Each true-class row divided by its total."""
    w = Window.partitionBy(*group, "label")
    return counts.select(*group, "label", "pred", F.round(F.col("n") / F.sum("n").over(w), digits).alias("share"))


def class_metrics(counts: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    """Per (group, class): precision, recall, f1, support (unrounded)."""
    c = counts.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    agg = c.groupBy(*group, "cls").agg(
        F.sum(F.when((F.col("label") == F.col("cls")) & (F.col("pred") == F.col("cls")), F.col("n"))
              .otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("label") == F.col("cls"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("pred") == F.col("cls"), F.col("n")).otherwise(0)).alias("predicted"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    agg = agg.withColumn("precision", p).withColumn("recall", r)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    return agg.withColumn("f1", f1)


def macro_metrics(counts: DataFrame, group: list[str], k: int = 3, digits: int = DIGITS) -> DataFrame:
    """Accuracy and macro precision / recall / F1 per group.

    One aggregate over the per-class table: summed over the classes, tp is
    the number of correct predictions and support the number of rows."""
    cm = class_metrics(counts, group, k).groupBy(*group).agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.sum("support").cast("long").alias("n"))
    return cm.select(*group, *[F.round(c, digits).alias(c) for c in
                               ["accuracy", "precision_macro", "recall_macro", "f1_macro"]], "n")


def metrics_from_matrix(models: DataFrame, k: int = 3) -> DataFrame:
    """Golden check: recompute the metrics of stored confusion matrices
    (model_name, confusion_matrix array<array<bigint>>)."""
    rows = models.select("model_name", F.posexplode("confusion_matrix").alias("label", "row"))
    cells = rows.select("model_name", "label", F.posexplode("row").alias("pred", "n"))
    return macro_metrics(cells, ["model_name"], k)
