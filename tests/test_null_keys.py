"""Null and repeated keys: text dedupe, statistics by group, and the bootstrap interval."""

import random

import numpy as np
from pyspark.sql import functions as F

from textlake.operators import clean as C
from textlake.operators import explore as X
from textlake.operators import vectors as VO


def test_dedupe_text_keeps_one_row_a_text(spark):
    rows = [(None, "a", 1), (None, "a", 2), (3, "b", 1), (3, "b", 1), (3, "c", 5), (1, "c", 9), (1, "c", 8), (None, "c", 0), (4, None, 1), (2, None, 1)]
    got = C.dedupe_text(spark.createDataFrame(rows, "review_id long, text string, other int")).collect()
    assert sorted(((r.text or "", r.review_id or 0) for r in got)) == [("", 2), ("a", 0), ("b", 3), ("c", 1)]
    again = C.dedupe_text(spark.createDataFrame(rows[::-1], "review_id long, text string, other int")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))  # whatever the order


def test_null_group_has_quartiles_and_whiskers(spark):
    rows = [(None, float(x)) for x in range(1, 10)] + [(1, 5.0), (1, 7.0), (1, None), (2, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    d = {r.g: r for r in X.describe_by_group(df, "g", "v").collect()}
    assert (d[None].v_p25, d[None].v_p50, d[None].v_p75, d[None].v_count) == (3.0, 5.0, 7.0, 9)
    assert (d[1].v_p50, d[1].v_nulls, d[2].v_p50, d[2].v_count) == (6.0, 1, None, 0)
    b = {r.g: r for r in X.box_stats(df, "g", "v").collect()}
    assert (b[None].q1, b[None].whisker_lo, b[None].whisker_hi) == (3.0, 1.0, 9.0)
    assert (b[1].whisker_lo, b[1].whisker_hi, b[2].whisker_lo) == (5.0, 7.0, None)


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(10, 2, 400)
    rows = [(i, "n", float(v)) for i, v in enumerate(x)] + [(1000 + i, "c", 3.0) for i in range(5)] + [(2000, "n", None), (None, "n", 99.0)] + [(3000, None, 1.0)]
    got = {r.g: r for r in X.bootstrap_ci(spark.createDataFrame(rows, "id long, g string, v double"), "g", "v", "id").collect()}
    half = 1.96 * x.std(ddof=1) / 20
    assert got["n"].replicates == 200 and abs(got["n"].mean - x.mean()) < 0.05
    assert abs(got["n"].ci_lo - (x.mean() - half)) < half / 2 and abs(got["n"].ci_hi - (x.mean() + half)) < half / 2
    assert got["c"].ci_lo == got["c"].ci_hi == 3.0 and got[None].mean == 1.0
    again = X.bootstrap_ci(spark.createDataFrame(rows[::-1], "id long, g string, v double").repartition(7), "g", "v", "id")
    assert {r.g: r.ci_lo for r in again.collect()} == {g: r.ci_lo for g, r in got.items()}
    draws = rng.integers(0, 2 ** 32, 200_000)
    weights = sum((draws >= limit).astype(int) for limit in X.poisson_limits())
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.03


def test_mean_cosine_of_many_groups(spark):
    rng = random.Random(2)
    rows = [(i % 30 if i % 30 else None, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, vec array<double>")
    got = {(r.g_a, r.g_b): (r.mean_cosine, r.n_pairs) for r in VO.mean_cosine_between_groups(df, "g", "vec").collect()}
    sums, counts = {}, {}
    for g, v in rows:
        sums[g], counts[g] = sums.get(g, np.zeros(4)) + v, counts.get(g, 0) + 1
    assert len(got) == 900
    for (a, b), (mean, n) in got.items():
        assert n == counts[a] * counts[b] and abs(mean - sums[a] @ sums[b] / n) < 1e-6


def test_profile_of_columns(spark):
    df = spark.createDataFrame([(1, None, [1]), (2, "x", None)], "`a b` long, s string, l array<int>")
    assert [tuple(r) for r in X.profile_columns(df).orderBy("position").collect()] == [(0, "a b", "bigint", 2, 0), (1, "s", "string", 1, 1), (2, "l", "array<int>", 1, 1)]
    assert [r.nulls for r in X.profile_columns(df.limit(0)).collect()] == [0, 0, 0]
    assert X.corr_long(spark.range(9).selectExpr("id a", "id * 2 b", "9 - id c"), ["a", "b", "c"]).where(F.abs("r") == 1).count() == 9
