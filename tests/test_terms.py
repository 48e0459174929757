"""Term counts by row, vocabularies, and frames whose texts are dealt out before terms are made of them."""

import collections

from textlake.operators import text as TX


def _rows():
    return [(1, "bb aa bb"), (2, "aa cc"), (2, "aa dd dd"), (None, "ee ff"), (None, "ee"), (3, None), (4, ""), (5, "solo")]


def test_counts_of_unique_ids_need_no_shuffle(spark):
    """Fails before: every (id, term) pair was shuffled."""
    df = spark.createDataFrame([(1, "bb aa bb aa cc"), (2, "aa cc"), (None, "x1 x1")], "id long, text string")
    got = TX.term_counts(df, "id", "text", (1, 2))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.where("id = 1").collect())) == [(1, "aa", 2), (1, "aa bb", 1), (1, "aa cc", 1), (1, "bb", 2), (1, "bb aa", 2), (1, "cc", 1)]


def test_counts_of_repeated_and_null_ids(spark):
    got = {(r["id"], r["term"]): r["tf"] for r in TX.term_counts(spark.createDataFrame(_rows(), "id long, text string"), "id", "text").collect()}
    want = collections.Counter((i, w) for i, t in _rows() for w in (t or "").split())
    assert got == want


def test_vocabulary_is_mllibs(spark):
    """The counts of MLlib's fit; equal frequencies are ordered by term."""
    from pyspark.ml.feature import CountVectorizer
    df = spark.createDataFrame([(["a", "b", "a", "c"],), (["b", "a"],), (["c", "d", "d", "d", "d"],), ([],), (["e", "a"],)], "terms array<string>")
    ours, mllib = TX.fit_counts(df, 10, 2), CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=10, minDF=2).fit(df)
    assert ours.vocabulary == ["a", "b", "c"] and sorted(mllib.vocabulary) == ours.vocabulary
    total = lambda m: {t: sum(float(r["tf"][i]) for r in m.transform(df).collect()) for i, t in enumerate(m.vocabulary)}
    assert total(ours) == total(mllib)


def test_frame_shuffles_texts_not_terms(spark, monkeypatch):
    """Fails before: the arrays of terms, larger than the texts, went through the split's join."""
    from textlake.operators import models as M
    seen = {}
    monkeypatch.setattr(M.S, "train_test_split", lambda df, cls: seen.setdefault("df", df).withColumn("split", M.F.lit("train")))
    clean = spark.createDataFrame([(i, "good thing lovely gift", 5.0) for i in range(6)], "review_id long, text string, rating double")
    frame = M.supervised_frame(clean)
    assert "terms" not in seen["df"].columns and {"terms", "ttr", "label", "w", "split"} <= set(frame.columns)
    assert frame.first()["terms"] == ["good", "thing", "lovely", "gift", "good thing", "thing lovely", "lovely gift"] and "text" not in frame.columns


def test_weights_do_not_deal_rows_out_by_class(spark):
    """Fails before: rows met their class's weight in one task a class."""
    from textlake.operators import models as M
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = M.with_balanced_weights(spark.createDataFrame([(i, i % 2) for i in range(8)] + [(9, None)], "id long, label int"))
        assert "SortMergeJoin" not in got._jdf.queryExecution().sparkPlan().toString()
        assert sorted((r["id"], round(r["w"], 6)) for r in got.collect()) == [(i, 0.75) for i in range(8)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shared_vectors_start_from_counted_terms(spark, monkeypatch):
    """Fails before: MLlib's fit held the terms of a partition, and the IDF's fit made all vectors a second time."""
    import math

    from pyspark.ml.feature import CountVectorizer

    from textlake.plans import q_ml as Q
    monkeypatch.setattr(CountVectorizer, "fit", lambda *a: (_ for _ in ()).throw(AssertionError("terms are held by the tasks")))
    rows = [(1, "aa bb aa"), (1, "aa the bb"), (None, "cc"), (2, "")]
    monkeypatch.setattr(Q.V, "reviews", lambda *a: None)
    monkeypatch.setattr(Q.V, "products", lambda *a: None)
    monkeypatch.setattr(Q.C, "clean_reviews", lambda *a: spark.createDataFrame(rows, "review_id long, text string"))
    model, pts = Q._tfidf_features(spark, "", 2)
    assert model.vocabulary == ["aa", "bb"] and pts.count() == 4
    idf = math.log(5 / 3)
    assert sorted([round(float(x), 9) for x in r.features.toArray()] for r in pts.collect()) == sorted(
        [[round(2 * idf, 9), round(idf, 9)], [round(idf, 9), round(idf, 9)], [0.0, 0.0], [0.0, 0.0]])


def test_ties_at_the_end_of_the_vocabulary_are_mllibs(spark):
    from pyspark.ml.feature import CountVectorizer
    df = spark.createDataFrame([(["f", "b", "a", "c"],), (["b", "a"],), (["c", "d", "d"],), ([],), (["e", "a"],)], "terms array<string>").coalesce(1)
    for n in range(1, 8):
        mllib = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=n).fit(df)
        assert set(TX.fit_frequent(df, n).vocabulary) == set(mllib.vocabulary)
