"""Ensembles over stored class probabilities.

``probs`` is the long table (model, review_id, label, proba array<double>).
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textlake.functions import vectors as VF
from textlake.operators import evaluate as EV

# The multiplier grid searched per class.
MULTIPLIERS = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]


def hard_predictions(probs: DataFrame) -> DataFrame:
    """T5: class of the highest probability (first index on ties)."""
    return probs.withColumn("pred", VF.argmax("proba"))


def weighted_vote(preds: DataFrame, weights: DataFrame) -> DataFrame:
    """Per review, sum each model's weight on the class it voted for;
    highest total wins, the lowest class on ties.

    The vote table is aggregated per (review, class) before ranking, so a
    review's group never holds more than k rows."""
    votes = preds.join(weights.select("model", "weight"), "model", "inner")
    tot = votes.groupBy("review_id", "label", "pred").agg(F.sum("weight").alias("score"))
    w = Window.partitionBy("review_id").orderBy(F.col("score").desc(), F.col("pred"))
    return (tot.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("review_id", "label", "pred", F.round("score", 6).alias("score")))


def mean_probabilities(probs: DataFrame, k: int = 3) -> DataFrame:
    """Soft vote: element-wise mean of the models' probability vectors."""
    ex = probs.select("review_id", "label", F.posexplode("proba").alias("i", "p"))
    m = ex.groupBy("review_id", "label", "i").agg(F.avg("p").alias("p"))
    arr = m.groupBy("review_id", "label").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("a"))
    return arr.select("review_id", "label", F.transform("a", lambda s: s["p"]).alias("proba"))


def multiplier_grid(values=MULTIPLIERS, k: int = 3):
    return list(itertools.product(values, repeat=k))


def threshold_grid(probs: DataFrame, values=MULTIPLIERS, k: int = 3) -> DataFrame:
    """Macro metrics of argmax(p * m) for every multiplier triple.

    Each row is expanded against the fixed 216-entry grid inside the same
    stage (generator feeding a partial aggregate), so what is shuffled is
    the (triple, label, pred) count table, never the expanded rows."""
    grid = F.array(*[F.struct(*[F.lit(float(v)).alias(f"m{j}") for j, v in enumerate(t)])
                     for t in multiplier_grid(values, k)])
    ex = probs.select("label", "proba", F.explode(grid).alias("g"))
    scaled = F.array(*[F.col("proba")[j] * F.col(f"g.m{j}") for j in range(k)])
    pred = VF.argmax(scaled)
    counts = ex.groupBy(*[F.col(f"g.m{j}").alias(f"m{j}") for j in range(k)], "label", pred.alias("pred")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return EV.macro_metrics(counts, [f"m{j}" for j in range(k)], k)


def best_thresholds(grid: DataFrame, k: int = 3) -> DataFrame:
    """Best triple by macro F1; the first triple in grid order wins ties."""
    ms = [f"m{j}" for j in range(k)]
    return grid.orderBy(F.col("f1_macro").desc(), *ms).limit(1)


def apply_thresholds(probs: DataFrame, best: DataFrame, k: int = 3) -> DataFrame:
    """Predictions with the chosen multipliers."""
    mult = [best.select(f"m{i}").scalar() for i in range(k)]  # scalar subqueries, evaluated once
    scaled = F.array(*[F.col("proba")[i] * mult[i] for i in range(k)])
    return probs.withColumn("pred", VF.argmax(scaled))
