"""Report documents and experiment-metric analytics.

Report documents are one-row DataFrames with nested maps/arrays, built from
small aggregates (one row per class) with ``collect_list`` -- the input to
each ``collect_list`` is bounded by the number of classes, never by the
number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import labels as L
from textlake.operators import features as FE


def dataset_report(canonical: DataFrame) -> DataFrame:
    """Total rows, rating and target-class distributions, columns and engineered features."""
    per = canonical.groupBy("rating", "target_class").agg(F.count(F.lit(1)).alias("n"))
    by_tc = per.groupBy("target_class").agg(F.sum("n").alias("n"))
    r = per.agg(F.sum("n").alias("total_rows"),
                F.map_from_entries(F.array_sort(F.collect_list(
                    F.struct(F.col("rating").cast("string").alias("k"), F.col("n").alias("v"))))).alias(
                    "rating_distribution"))
    t = by_tc.agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("target_class").alias("k"), F.col("n").alias("v"))))))
    names = lambda cols: F.array(*[F.lit(c) for c in cols])
    return r.withColumn("target_class_distribution", t.scalar()).withColumn("columns", names(canonical.columns)).withColumn(
        "features", names([c for c in FE.FEATURES if c in canonical.columns]))


METRIC_COLS = ["f1_macro", "precision_macro", "recall_macro", "accuracy"]


def metrics_long(models: DataFrame) -> DataFrame:
    """Model x metric long table."""
    present = [c for c in METRIC_COLS if c in models.columns]
    return models.unpivot(["model_name"], present, "metric", "value").where(F.col("value").isNotNull())


def f1_vs_time(models: DataFrame) -> DataFrame:
    """Rows missing F1 or training time are dropped."""
    return models.select("model_name", "f1_macro", "training_time_seconds").dropna()


def per_class_rows(models: DataFrame) -> DataFrame:
    """(model, class, precision, recall, f1) from the ``per_class`` map."""
    m = models.where(F.col("per_class").isNotNull())
    return m.select("model_name", F.explode("per_class").alias("cls", "s")).select(
        "model_name", "cls", "s.precision", "s.recall", "s.f1")


def radar_rows(models: DataFrame) -> DataFrame:
    """E5: macro F1 and the three class F1 values per model."""
    pc = per_class_rows(models).groupBy("model_name").pivot("cls", L.CLASS_LABELS).agg(F.first("f1"))
    return models.select("model_name", "f1_macro").join(pc, "model_name", "inner")


def confusion_cells(models: DataFrame) -> DataFrame:
    """(model, true, pred, n) for models that carry a matrix."""
    m = models.where(F.col("confusion_matrix").isNotNull())
    rows = m.select("model_name", F.posexplode("confusion_matrix").alias("true_code", "row"))
    return rows.select("model_name", "true_code", F.posexplode("row").alias("pred_code", "n"))


def model_rank(models: DataFrame) -> DataFrame:
    """Each metric ranked over models (1 = best, equal values share a rank)."""
    from pyspark.sql import Window
    long = metrics_long(models)
    w = Window.partitionBy("metric").orderBy(F.col("value").desc())
    return long.withColumn("rank", F.rank().over(w))
