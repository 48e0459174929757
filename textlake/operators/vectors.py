"""Vector aggregates.

The reference draws a 300 x 300 cosine matrix of a per-class sample. The data
behind that heatmap is the mean similarity between classes, and for unit
vectors it needs no pairs at all:

    mean_{a in A, b in B} cos(a, b) = (sum_A a) . (sum_B b) / (|A| |B|)

so it is computed over *all* rows with one vector-sum aggregate per class
(MLlib ``Summarizer``, partial aggregation per task) and a classes x classes
combination of the per-class sums, by blocks of classes.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import vectors as VF
from textlake.session import staged

#: Groups are dealt into so many blocks; every two blocks are combined by one task.
GROUP_BLOCKS = 8


def group_sums(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, sum array<double>, n) with one partial+final aggregate."""
    s = df.groupBy(group).agg(Summarizer.metrics("sum", "count").summary(array_to_vector(F.col(vec))).alias("s"))
    return s.select(group, vector_to_array("s.sum").alias("sum"), F.col("s.count").alias("n"))


def group_means(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, vec): element-wise mean vector per group (search prototypes)."""
    m = df.groupBy(group).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("m"))
    return m.select(group, vector_to_array("m").alias("vec"))


def mean_cosine_between_groups(unit: DataFrame, group: str, vec: str, digits: int = 6) -> DataFrame:
    """Mean pairwise cosine between every two groups (incl. a group with itself)."""
    sums = staged(group_sums(unit, group, vec))
    own = F.pmod(F.xxhash64(group), F.lit(GROUP_BLOCKS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(GROUP_BLOCKS - 1)))
    a = sums.select(own.alias("_i"), every.alias("_j"), F.col(group).alias(f"{group}_a"), F.col("sum").alias("_a"), F.col("n").alias("_na"))
    b = sums.select(own.alias("_j"), every.alias("_i"), F.col(group).alias(f"{group}_b"), F.col("sum").alias("_b"), F.col("n").alias("_nb"))
    n = F.col("_na") * F.col("_nb")
    return a.join(b, ["_i", "_j"]).select(f"{group}_a", f"{group}_b", F.round(VF.dot("_a", "_b") / n, digits).alias("mean_cosine"), n.cast("bigint").alias("n_pairs"))
