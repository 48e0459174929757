"""Distributed exact percentiles equal Spark's ``percentile`` (linear
interpolation), with ties, nulls, tiny and empty groups, and when the sketch
bracket misses (fallback path)."""

import random

import pytest
from pyspark.sql import functions as F

from textlake.operators import explore as X

PS = [0.25, 0.5, 0.75, 0.95]
NAMES = ["q1", "med", "q3", "p95"]


def _data(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for g, n in [(1, 1), (2, 2), (3, 57), (4, 3000), (5, 0)]:
        for _ in range(n):
            rows.append((g, float(rnd.choice([rnd.randint(0, 20), rnd.random()]))))
        rows.append((g, None))
    return spark.createDataFrame(rows, "g int, v double")


def _want(df, keys):
    aggs = [F.percentile("v", F.lit(p)).alias(n) for p, n in zip(PS, NAMES)]
    return {tuple(r[k] for k in keys): tuple(r[n] for n in NAMES)
            for r in (df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)).collect()}


def _got(df, keys):
    return {tuple(r[k] for k in keys): tuple(r[n] for n in NAMES)
            for r in X.exact_percentiles(df, keys, "v", PS, NAMES).collect()}


def _close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or abs(x - y) < 1e-12, (k, a[k], b[k])


@pytest.mark.parametrize("seed", [1, 2])
def test_grouped_and_global(spark, seed):
    df = _data(spark, seed)
    _close(_got(df, ["g"]), _want(df, ["g"]))
    _close(_got(df, []), _want(df, []))


def test_fallback_when_bracket_misses(spark, monkeypatch):
    df = _data(spark, 3)
    monkeypatch.setattr(X, "MARGIN", -0.2)  # brackets that cannot hold the ranks
    _close(_got(df, ["g"]), _want(df, ["g"]))


def test_equal_values_are_one_entry(spark):
    """A column of five ratings, 40 % of them equal: what the window sees is
    counts by value, however many rows there are."""
    rows = spark.range(40_000).select(F.struct(F.lit(0).alias("_g")).alias("_k"),
                                      F.when(F.col("id") % 5 < 2, 5.0).otherwise((F.col("id") % 4).cast("double")).alias("_v"))
    whole = spark.range(3).select(F.struct(F.lit(0).alias("_g")).alias("_k"), F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("lo"),
                                  F.lit(0).cast("long").alias("hi"), F.lit(0.0).alias("f"), F.lit(float("-inf")).alias("a"), F.lit(float("inf")).alias("b"))
    assert X.bracket_counts(rows, whole).count() == 3 * 5
    df = rows.select("_v").withColumnRenamed("_v", "v")
    _close(_got(df, []), _want(df, []))


def test_null_groups_keep_their_percentiles(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (2, 5.0), (3, None)], "g int, v double")
    _close(_got(df, ["g"]), _want(df, ["g"]))
