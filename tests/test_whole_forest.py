"""Forests of all rows, frames that move texts once, and vocabularies from counted tokens."""

import collections
import random

import numpy as np
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from textlake.operators import clean as C
from textlake.operators import forest as FO
from textlake.operators import models as M
from textlake.operators import text as TX


def test_trees_draw_as_many_rows_as_there_are(spark):
    """Fails before: a tree drew a twentieth of the rows."""
    assert M.random_forest()(None).getSubsamplingRate() == 1.0


def test_thresholds_know_every_row(spark):
    """Fails before: thresholds came from 10,000 rows, which miss most values that occur once."""
    x = spark.range(40_000).select(F.lit(1.0).alias("w"), F.array(F.lit(0), F.lit(2)).alias("j"),
                                   F.array(F.when(F.col("id") % 5000 == 7, F.col("id").cast("double")).otherwise(1.0), F.lit(-1.0)).alias("v"))
    found = FO.thresholds(x, 3, 32)
    values = [1.0, *(float(i) for i in range(7, 40_000, 5000))]
    assert found[0, :8].tolist() == [(a + b) / 2 for a, b in zip(values, values[1:])] and np.isinf(found[0, 8:]).all()
    assert np.isinf(found[1:]).all()


def test_trees_grown_some_at_a_time_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i % 3, 1.0, SparseVector(20, [(int(j), float(rng.random())) for j in np.flatnonzero(rng.random(20) < 0.4)])) for i in range(200)]
    df = spark.createDataFrame(rows, ["label", "w", "features"]).coalesce(1).checkpoint()
    args = dict(numTrees=7, maxDepth=8, featureSubsetStrategy="sqrt", weightCol="w", seed=3)
    whole = FO.DeepForestClassifier(**args).fit(df)
    monkeypatch.setattr(FO, "DEALT_COPIES", 1)
    monkeypatch.setattr(FO, "NODE_ROWS", 60)
    assert FO.DeepForestClassifier(**args).fit(df).toDebugString.split("\n")[1:] == whole.toDebugString.split("\n")[1:]


def test_vocabulary_of_tokens_and_pairs(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.5)), 400)}" for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["", "w1", None]
    df = spark.createDataFrame([(t,) for t in texts], "tokens string")
    seen, times = collections.Counter(), collections.Counter()
    for t in texts:
        words = (t or "").split()
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        times.update(terms)
        seen.update(set(terms))
    for size, least in ((1, 1), (25, 3), (120, 1), (5000, 2)):
        want = sorted(((t, seen[t], n) for t, n in times.items() if seen[t] >= least), key=lambda r: (-r[2], r[0]))[:size]
        assert [tuple(r) for r in TX.top_ngrams(df, "tokens", size, least)] == want


def test_keys_and_texts_are_the_clean_reviews(spark):
    """Repeated ids and texts, and a product that is listed twice."""
    rows = [(1, "good thing lovely gift for all", 5.0, "a", True), (2, "good thing lovely gift for all", 4.0, "b", True), (2, "another text of five words", 4.0, "b", True), (2, "another text of five words", 4.0, "b", True),
            (3, None, 1.0, "a", True), (4, "not verified but long enough text", 1.0, "a", False), (5, "a text of no listed product", 3.0, "x", True), (6, "short one", 3.0, "a", True)]
    reviews = spark.createDataFrame([(*r, 0, "t", 7) for r in rows], "review_id long, text string, rating double, parent_asin string, verified_purchase boolean, helpful_vote int, title string, timestamp long")
    products = spark.createDataFrame([("a", "m"), ("b", "m"), ("b", "n"), ("c", None)], "parent_asin string, main_category string")
    keyed = reviews.withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256))
    cols = ["review_id", "text", "rating", "parent_asin", "main_category"]
    got = C.clean_keys(keyed, products).join(C.texts_by_key(keyed), "text_key").select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.clean_reviews(reviews, products).select(*cols).collect()))
    assert got.count() == 3
