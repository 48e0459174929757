"""Batch scoring (L7) and the embedding classifier: invariants of the output,
normalization inside the pipeline."""

import math

import pytest

from tests.conftest import SF_SMALL
from textlake.operators import models as M


@pytest.fixture(scope="module")
def scored(spark):
    import __spark_entry__ as E
    return E.queries()["score_batch"](spark, SF_SMALL).collect()


def test_score_batch_invariants(scored):
    assert scored
    names = ["Negativo", "Neutro", "Positivo"]
    for r in scored:
        assert r["sentiment"] == names[r["sentiment_code"]]
        probs = r["probabilities"]
        assert set(probs) == set(names)
        assert abs(sum(probs.values()) - 1.0) < 1e-3
        assert r["confidence"] == max(probs.values())
        assert probs[r["sentiment"]] == r["confidence"]


def test_score_batch_covers_whole_test_split(spark, scored):
    from textlake.operators import clean as C
    from textlake.operators import sampling as S
    from textlake.sources import views as V
    clean = C.clean_reviews(V.reviews(spark, SF_SMALL), V.products(spark, SF_SMALL))
    from textlake.functions import labels as L
    f = clean.select("review_id", L.sentiment_class("rating").alias("label"))
    test = S.train_test_split(f, "label").where("split = 'test'")
    assert sorted(r["review_id"] for r in scored) == sorted(r["review_id"] for r in test.collect())


def test_normalization_inside_pipeline(spark):
    """A scaled copy of a vector scores exactly like the unit vector."""
    rows = []
    for i in range(60):
        lab = i % 3
        v = [0.0] * 4
        v[lab] = 1.0
        v[3] = (i % 5) / 10.0
        rows.append((i, lab, v, 1.0))
    df = spark.createDataFrame(rows, "review_id long, label int, embedding array<double>, w double")
    model = M.embedding_classifier(df).fit(df)
    scaled = df.selectExpr("review_id", "label", "transform(embedding, x -> x * 7.5) AS embedding", "w")
    a = {r["review_id"]: r["probabilities"] for r in M.score_batch(model, df, ["a", "b", "c"], 6).collect()}
    b = {r["review_id"]: r["probabilities"] for r in M.score_batch(model, scaled, ["a", "b", "c"], 6).collect()}
    for k in a:
        for c in a[k]:
            assert math.isclose(a[k][c], b[k][c], abs_tol=1e-6)


def test_penalty_and_features_by_hand(spark):
    """regParam is 1 / (C * sum of weights); text rows have unit length with
    idf ln((1 + n) / (1 + df)) + 1, features the population deviation."""
    from textlake.operators import features as FE
    rows = [(i, ["a", "b"] if i % 2 else ["a"], 0.5 + i % 2, *[float(i + j) for j in range(len(FE.FEATURES))]) for i in range(8)]
    df = spark.createDataFrame(rows, "review_id long, terms array<string>, w double, " + ", ".join(f"{c} double" for c in FE.FEATURES))
    assert M.logreg(2.0)(df).getRegParam() == pytest.approx(1 / (2.0 * 8))
    x = {r.review_id: r.features.toArray() for r in M.fit_features(df, min_df=1).transform(df).collect()}
    a, b = 1.0, math.log(9 / 5) + 1
    n = math.hypot(a, b)
    assert sorted(x[1][:2]) == pytest.approx(sorted([a / n, b / n])) and sorted(x[0][:2]) == pytest.approx([0.0, 1.0])
    assert x[0][2] == pytest.approx((0 - 3.5) / math.sqrt(5.25))


def test_saved_text_model_scores_texts(spark, tmp_path):
    """S14 + L7: a pipeline from text, and one from embeddings, saved and loaded."""
    from pyspark.ml import PipelineModel

    words = {0: "broken awful refund", 1: "okay average fine", 2: "great lovely perfect"}
    rows = [(i, f"{words[i % 3]} item{i % 7}", i % 3, 1.0) for i in range(90)]
    train = spark.createDataFrame(rows, "review_id long, text string, label int, w double")
    asked = spark.createDataFrame([(1, "lovely perfect gift", "x"), (2, "awful broken", None), (3, None, "y")], "review_id long, text string, other string")
    model = M.text_classifier(train, max_iter=20, dim=64).fit(train)
    model.write().overwrite().save(f"{tmp_path}/m")
    loaded = PipelineModel.load(f"{tmp_path}/m")
    assert loaded.stages[0].getOrDefault("dim") == 64
    a, b = (sorted(map(tuple, M.score_batch(m, asked, ["neg", "neu", "pos"]).drop("probabilities").collect())) for m in (model, loaded))
    assert a == b and [r[1] for r in a[:2]] == ["pos", "neg"] and len(a) == 3
    from textlake.operators.encode import HashEncoder, encode_batches

    encoded = encode_batches(train, HashEncoder(64))
    m2 = M.embedding_classifier(encoded, max_iter=20).fit(encoded)
    m2.write().overwrite().save(f"{tmp_path}/e")
    same = PipelineModel.load(f"{tmp_path}/e").transform(encode_batches(asked, HashEncoder(64))).select("review_id", "prediction").collect()
    assert sorted(same) == sorted(m2.transform(encode_batches(asked, HashEncoder(64))).select("review_id", "prediction").collect())


def test_macro_f1_evaluator(spark):
    rows = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 1.0), (1, 1.0), (2, 0.0), (2, 2.0)], "label int, prediction double")
    want = (0.5 + 0.8 + 2 / 3) / 3
    assert abs(M.MacroF1().evaluate(rows) - want) < 1e-5 and M.MacroF1().isLargerBetter()
    assert M.metrics_row(rows, "x", 0.0).first()["f1_macro"] == M.MacroF1().evaluate(rows)


def test_svd_projection_and_kmeans_starts(spark):
    """C4 and C1 against numpy: coordinates, energies, and the best of several starts."""
    import numpy as np
    from pyspark.ml.linalg import SparseVector, Vectors

    from textlake.operators import clusters as CL

    rng = np.random.default_rng(3)
    x = np.where(rng.random((60, 12)) < 0.4, rng.normal(size=(60, 12)), 0.0)
    x[7] = 0
    rows = [(i, SparseVector(12, [(int(j), float(v[j])) for j in np.flatnonzero(v)]) if i % 2 else Vectors.dense(v)) for i, v in enumerate(x)]
    pts = spark.createDataFrame(rows, ["review_id", "features"])
    v, squared, total = CL.right_vectors(pts, 3)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(squared, s[:3] ** 2) and abs(total - (s ** 2).sum()) < 1e-9
    got = np.array([r[1:] for r in sorted(CL.svd_project(pts, v).collect())])
    assert np.allclose(np.abs(got), np.abs(x @ vt[:3].T)) and np.allclose(got, x @ v)
    assert [r["singular_value"] for r in CL.svd_values(pts, 2).orderBy("component").collect()] == [round(float(c), 6) for c in s[:2]]
    model, costs = CL.kmeans_best(pts, 5, starts=4)
    assert len(costs) == 4 and model.summary.trainingCost == min(costs)


def test_principal_axes_from_the_sparse_gramian(spark, monkeypatch):
    """C3 against numpy. Fails before: MLlib's fit expanded every sparse row to all features."""
    import numpy as np
    from pyspark.ml import feature
    from pyspark.ml.linalg import SparseVector, Vectors

    from textlake.operators import clusters as CL

    monkeypatch.setattr(feature.PCA, "fit", lambda *a: (_ for _ in ()).throw(AssertionError("rows are expanded")))
    rng = np.random.default_rng(4)
    x = np.where(rng.random((50, 9)) < 0.4, rng.normal(1, 1, (50, 9)) * np.arange(1, 10), 0.0)
    rows = [(i // 2 if i > 1 else None, SparseVector(9, [(int(j), float(v[j])) for j in np.flatnonzero(v)]) if i % 3 else Vectors.dense(v)) for i, v in enumerate(x)]
    out = CL.pca_project(spark.createDataFrame(rows, ["review_id", "features"]), 2)
    axes = np.linalg.svd(np.cov(x.T))[0][:, :2]
    want = sorted(np.round(np.abs(x @ axes), 6).tolist())
    assert out.columns == ["review_id", "pc1", "pc2"]
    got = out.collect()
    assert np.allclose(sorted([abs(r.pc1), abs(r.pc2)] for r in got), want, atol=2e-6)
    assert sum(r.review_id is None for r in got) == 2 and len(got) == 50
