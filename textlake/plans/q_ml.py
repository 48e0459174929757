"""Queries: MLlib models, clustering and projections (rows-only checks).

Model quality on the synthetic test tables is not comparable with the
queries are checked for shape and invariants, not values.
"""

from __future__ import annotations

import time

from pyspark.ml.feature import CountVectorizer, IDF
from pyspark.sql import functions as F

from textlake.operators import clean as C
from textlake.operators import clusters as CL
from textlake.operators import models as M
from textlake.operators import search as R
from textlake.operators import text as TX
from textlake.operators import vectors as VO
from textlake.plans.registry import register
from textlake.plans.sqlviews import with_ctes
from textlake.session import materialize, staged
from textlake.sources import io as IO
from textlake.sources import views as V


def _frame(spark, sf):
    reviews = V.reviews(spark, sf, text_key=True)
    return M.supervised_frame(C.clean_keys(reviews, V.products(spark, sf)), C.texts_by_key(reviews))


@register("logreg_eval", "ml")
def logreg_eval(spark, sf):
    return M.fit_evaluate(_frame(spark, sf), M.logreg(C=1.0), "logreg")[2]


@register("rf_eval", "ml")
def rf_eval(spark, sf):
    return M.fit_evaluate(_frame(spark, sf), M.random_forest(), "random_forest")[2]


@register("rf_embedding_eval", "ml")
def rf_embedding_eval(spark, sf):
    """L2 with four rows a leaf, on the embedding and the nine features."""
    return M.fit_evaluate(_embedding_frame(spark, sf), M.random_forest(rate=M.MAX_SAMPLES, min_leaf=4), "random_forest_leaf4", M.fit_embedding_features)[2]


@register("gbt_ovr_eval", "ml")
def gbt_ovr_eval(spark, sf):
    return M.fit_evaluate(_frame(spark, sf), M.boosted_ovr(), "gbt_ovr")[2]


@register("svc_ovr_eval", "ml")
def svc_ovr_eval(spark, sf):
    return M.fit_evaluate(_frame(spark, sf), M.linear_svc_ovr(max_iter=100), "linear_svc_ovr")[2]


@register("model_leaderboard", "ml")
def model_leaderboard(spark, sf):
    """The leaderboard, exported as CSV and read back."""
    board = materialize(M.model_search(_frame(spark, sf)))
    path = IO.write_csv(board.coalesce(1), f"{IO.scratch(spark, 'leaderboard')}/csv", gzip=False)
    return IO.read_csv(spark, path, board.schema)


@register("feature_importance", "ml", "SELECT 10::BIGINT AS features, 1.0::DOUBLE AS total, true AS all_positive")
def feature_importance(spark, sf):
    """The text block and the nine features, whose importances add up to one."""
    _, model, _ = M.fit_evaluate(_frame(spark, sf), M.random_forest(rate=M.MAX_SAMPLES), "random_forest")
    rows = spark.createDataFrame(M.grouped_importance(model), "feature string, importance double")
    return rows.agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("all_positive"))


@register("feature_importance_terms", "ml")
def feature_importance_terms(spark, sf):
    """The 15 largest importances of a forest and of the mean absolute coefficients, by name."""
    frame, rows = _frame(spark, sf), []
    for name, make in (("random_forest", M.random_forest(rate=M.MAX_SAMPLES)), ("logreg", M.logreg())):
        prepare, model, _ = M.fit_evaluate(frame, make, name)
        rows += [(name, i + 1, t, round(v, 6)) for i, (t, v) in enumerate(M.top_terms(prepare, model, 15))]
    return spark.createDataFrame(rows, "model string, rank int, feature string, importance double")


@register("stacking_eval", "ml")
def stacking_eval(spark, sf):
    """L10 over L1-L3, the regressions with 100 iterations at most."""
    return M.stacking(_frame(spark, sf), {"logreg": M.logreg(max_iter=100), "random_forest": M.random_forest(), "gbt_ovr": M.boosted_ovr()})


def _unit_points(spark, sf):
    idx = R.build_vector_index(V.vectors(spark, sf), keep=["label"])
    return materialize(CL.vectors_as_features(idx))


@register("kmeans_sweep", "ml")
def kmeans_sweep(spark, sf):
    return CL.kmeans_sweep(_unit_points(spark, sf), range(2, 9))


def _tfidf_features(spark, sf, vocab: int):
    """(vocabulary model, the rows' IDF-weighted counts). A row's terms are read
    twice, to be counted and to become a vector; all else starts from the vectors."""
    clean = C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))
    t = materialize(TX.with_terms(clean.select("review_id", "text"), "text", (1, 1), TX.english_stop_words(), name="terms"))
    m = TX.fit_frequent(t, vocab)
    tf = materialize(m.transform(t).select("review_id", "tf"))
    return m, IDF(inputCol="tf", outputCol="features").fit(tf).transform(tf)


@register("kmeans_tfidf_terms", "ml")
def kmeans_tfidf_terms(spark, sf):
    from pyspark.ml.clustering import KMeans
    _, pts = _tfidf_features(spark, sf, 1500)
    km = KMeans(k=4, seed=42, featuresCol="features", predictionCol="cluster").fit(pts)
    assign = km.transform(pts).select("review_id", "cluster")
    clean = C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))
    weights = TX.fit_tfidf(clean, "review_id", "text", (1, 1), TX.english_stop_words(), max_features=1500).weights
    return CL.cluster_top_terms(weights, assign, 10)


@register("pca2", "ml")
def pca2(spark, sf):
    _, pts = _tfidf_features(spark, sf, 1500)
    return CL.pca_project(pts, 2)


@register("svd3", "ml")
def svd3(spark, sf):
    _, pts = _tfidf_features(spark, sf, 1500)
    return CL.svd_values(pts, 3)


_CLEAN_ROWS = "(SELECT count(*) FROM clean)"


@register("svd_projection", "ml", with_ctes(
    f"SELECT {_CLEAN_ROWS} AS n, true AS orthogonal, true AS energy_is_squared_value, true AS descending, true AS residual_agrees", "clean"))
def svd_projection(spark, sf):
    """C4: every row on three components. Checked on all rows: the components are
    orthogonal, their energies are the squared singular values in order, and what
    the rows lose by the projection is the rest of the Gramian's trace."""
    _, pts = _tfidf_features(spark, sf, 1500)
    v, squared, total = CL.right_vectors(pts, 3)
    s = CL.svd_project(pts, v)
    dots = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"d{i}{j}") for i in (1, 2, 3) for j in range(i, 4)]
    r = s.agg(F.count("*").alias("n"), *dots).first()
    energy = [r[f"d{i}{i}"] for i in (1, 2, 3)]
    length = pts.select(F.unwrap_udt("features").alias("f")).agg(F.sum(F.aggregate("f.values", F.lit(0.0), lambda a, x: a + x * x)).alias("t")).first()["t"]
    near = lambda a, b: abs(a - b) <= 1e-6 * max(abs(a), abs(b), 1.0)
    orthogonal = all(abs(r[f"d{i}{j}"]) <= 1e-6 * (energy[i - 1] * energy[j - 1]) ** 0.5 + 1e-9 for i in (1, 2, 3) for j in range(i + 1, 4))
    return spark.createDataFrame([(r["n"], orthogonal, all(map(near, energy, squared)), energy == sorted(energy, reverse=True), bool(near(length - sum(energy), total - sum(squared))))],
                                 "n long, orthogonal boolean, energy_is_squared_value boolean, descending boolean, residual_agrees boolean")


@register("kmeans_svd", "ml", with_ctes(
    f"SELECT {_CLEAN_ROWS} AS n, 4::BIGINT AS clusters, 10::BIGINT AS starts, true AS best_is_least, true AS inertia_agrees", "clean"))
def kmeans_svd(spark, sf):
    """K-Means on the three components, ten starts, the best kept; its inertia is the sum over the assigned rows."""
    from pyspark.ml.functions import array_to_vector
    _, pts = _tfidf_features(spark, sf, 1500)
    s = CL.svd_project(pts, CL.right_vectors(pts, 3)[0])
    s = materialize(s.select("review_id", F.array("s1", "s2", "s3").alias("x"), array_to_vector(F.array("s1", "s2", "s3")).alias("features")))
    model, costs = CL.kmeans_best(s, 4)
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    far = F.aggregate(F.zip_with("x", F.get(centers, "cluster"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, d: a + d)
    r = model.transform(s).agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("c"), F.sum(far).alias("d")).first()
    return spark.createDataFrame([(r["n"], r["c"], len(costs), model.summary.trainingCost == min(costs), abs(r["d"] - min(costs)) <= 1e-6 * max(1.0, min(costs)))],
                                 "n long, clusters long, starts long, best_is_least boolean, inertia_agrees boolean")


@register("lda_topics", "ml")
def lda_topics(spark, sf):
    clean = C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))
    t = TX.with_terms(clean.select("review_id", "text"), "text", (1, 1), TX.english_stop_words(), name="terms")
    cv = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=1000).fit(t)
    return CL.lda_topics(cv.transform(t), list(cv.vocabulary), k=5)


@register("ann_recall", "ml")
def ann_recall(spark, sf):
    idx = R.build_vector_index(V.vectors(spark, sf), keep=["label"])
    protos = VO.group_means(idx, "label", "vec").withColumnRenamed("label", "query_id")
    exact = R.semantic_search(idx, protos, k=10)
    return CL.ann_recall(idx, protos, exact, k=10)




def _embedding_frame(spark, sf):
    from textlake.operators.encode import hash_embed
    clean = C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))
    return M.embedding_frame(clean, lambda d: hash_embed(d, "review_id", "text"))


@register("embed_logreg_eval", "ml")
def embed_logreg_eval(spark, sf):
    """L1 on embeddings: encoder output -> normalize -> multinomial LR; test metrics."""
    f = _embedding_frame(spark, sf)
    t0 = time.time()
    train = f.where(F.col("split") == "train")
    model = M.embedding_classifier(train).fit(train)
    return M.metrics_row(model.transform(f.where(F.col("split") == "test")), "logreg_embeddings", time.time() - t0)


@register("score_batch", "ml")
def score_batch(spark, sf):
    """Fit on the train split, then score the held-out batch: class,
    code, confidence and the probability map per review."""
    from textlake.functions.labels import CLASS_LABELS
    f = _embedding_frame(spark, sf)
    train = f.where(F.col("split") == "train")
    model = M.embedding_classifier(train).fit(train)
    return M.score_batch(model, f.where(F.col("split") == "test"), CLASS_LABELS)


@register("text_model_roundtrip", "ml", "SELECT 0::BIGINT AS text_mismatches, 0::BIGINT AS embedding_mismatches, true AS any_rows")
def text_model_roundtrip(spark, sf):
    """S14 + L7: the text and the embedding pipeline are saved, loaded, and score the held-out rows alike."""
    from pyspark.ml import PipelineModel
    from textlake.functions.labels import CLASS_LABELS
    from textlake.operators.encode import HashEncoder, encode_batches
    base = IO.scratch(spark, "text-model")
    f = M.text_frame(C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf)))
    # encoded once: the fit, its penalty and both scorings would encode all rows again
    texts, encoded = f, staged(encode_batches(f, HashEncoder()).drop("text"))
    counts = []
    for name, frame, make in (("text", texts, M.text_classifier), ("embedding", encoded, M.embedding_classifier)):
        train, test = frame.where("split = 'train'"), frame.where("split = 'test'").drop("label", "w")
        model = make(train).fit(train)
        model.write().overwrite().save(f"{base}/{name}")
        loaded = PipelineModel.load(f"{base}/{name}")
        a, b = (M.score_batch(m, test, CLASS_LABELS).select("review_id", F.struct("sentiment", "confidence", F.to_json("probabilities")).alias(c)) for m, c in ((model, "a"), (loaded, "b")))
        counts.append(a.join(b, "review_id", "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias(f"{name}_mismatches"), F.count("*").alias(f"{name}_rows")).first())
    t, e = counts
    return spark.createDataFrame([(t["text_mismatches"], e["embedding_mismatches"], t["text_rows"] > 0 and t["text_rows"] == e["embedding_rows"])],
                                 "text_mismatches long, embedding_mismatches long, any_rows boolean")


@register("feature_importance_embedding", "ml", "SELECT 10::BIGINT AS features, 1.0::DOUBLE AS total, true AS all_positive, true AS has_block")
def feature_importance_embedding(spark, sf):
    """The embedding as one block beside the nine features."""
    _, model, _ = M.fit_evaluate(_embedding_frame(spark, sf), M.random_forest(rate=M.MAX_SAMPLES, min_leaf=4), "random_forest_leaf4", M.fit_embedding_features)
    rows = spark.createDataFrame(M.grouped_importance(model, "embedding_block"), "feature string, importance double")
    return rows.agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("all_positive"),
                    (F.count_if(F.col("feature") == "embedding_block") == 1).alias("has_block"))


@register("tune_forest", "ml", "SELECT 2::BIGINT AS grid_points, true AS best_is_largest, true AS same_as_metrics")
def tune_forest(spark, sf):
    """2.17 + L5: a grid over the least leaf size by macro F1; the metric's value on
    the held-out rows is that of the metrics table."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.tuning import ParamGridBuilder
    frame = _embedding_frame(spark, sf)
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    prepare = M.fit_embedding_features(train)
    x = materialize(prepare.transform(train).select("review_id", "label", "w", "features"))
    forest = RandomForestClassifier(numTrees=20, maxDepth=12, featureSubsetStrategy="sqrt", weightCol="w", seed=42)
    model, points = M.tune(x, forest, ParamGridBuilder().addGrid(forest.minInstancesPerNode, [1, 4]).build())
    pred = materialize(model.transform(prepare.transform(test)).select("label", "prediction"))
    value, table = M.MacroF1().evaluate(pred), M.metrics_row(pred, "forest", 0.0).first()["f1_macro"]
    best = max(points, key=lambda p: p[1])[0]["minInstancesPerNode"]
    return spark.createDataFrame([(len(points), best == model.getMinInstancesPerNode(), value == table)], "grid_points long, best_is_largest boolean, same_as_metrics boolean")


_TEST_ROWS = ("SELECT sum((n * 20 + 99) // 100)::BIGINT FROM (SELECT count(*) AS n FROM clean GROUP BY "
              "CASE WHEN rating IN (1, 2) THEN 0 WHEN rating = 3 THEN 1 ELSE 2 END)")
_METRICS = ("accuracy", "precision_macro", "recall_macro", "f1_macro")


@register("logreg_eval_checks", "ml", with_ctes(f"SELECT ({_TEST_ROWS}) AS n, true AS in_range, true AS agrees", "clean"))
def logreg_eval_checks(spark, sf):
    """V4 + L1 (50 iterations): the metrics of the held-out rows, counted again from the predictions."""
    frame = _frame(spark, sf)
    prepare, model, row = M.fit_evaluate(frame, M.logreg(max_iter=50), "logreg")
    r = row.first()
    pred = model.transform(prepare.transform(frame.where("split = 'test'"))).select("label", F.col("prediction").cast("int").alias("p"))
    cells = {(c["label"], c["p"]): c["count"] for c in pred.groupBy("label", "p").count().collect()}  # K * K rows
    right = sum(n for (a, b), n in cells.items() if a == b)
    recall = [cells.get((c, c), 0) / max(1, sum(n for (a, _), n in cells.items() if a == c)) for c in range(M.K)]
    agrees = abs(r["accuracy"] - right / max(1, r["n"])) < 1e-5 and abs(r["recall_macro"] - sum(recall) / M.K) < 1e-5 and sum(cells.values()) == r["n"]
    return spark.createDataFrame([(r["n"], all(0 <= r[m] <= 1 for m in _METRICS), bool(agrees))], "n long, in_range boolean, agrees boolean")


@register("score_batch_checks", "ml", with_ctes(f"SELECT ({_TEST_ROWS}) AS n, 0::BIGINT AS off_sum, 0::BIGINT AS off_confidence, 0::BIGINT AS off_class", "clean"))
def score_batch_checks(spark, sf):
    """Every held-out review is scored; probabilities add up to one, the
    confidence is the largest, and the class is its."""
    s = score_batch(spark, sf)
    p = F.map_values("probabilities")
    return s.agg(F.count("*").alias("n"), F.count_if(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 2e-4).alias("off_sum"),
                 F.count_if(F.array_max(p) != F.col("confidence")).alias("off_confidence"),
                 F.count_if(F.element_at("probabilities", F.col("sentiment")) != F.col("confidence")).alias("off_class"))


@register("cluster_checks", "ml", with_ctes(
    "SELECT 7::BIGINT AS ks, true AS inertia_falls, true AS silhouette_in_range, true AS indices_positive, count(*) AS pca_rows, true AS pca_ordered, true AS pca_orthogonal, "
    "40::BIGINT AS topic_terms, true AS topics_ordered FROM clean", "clean"))
def cluster_checks(spark, sf):
    """What must hold for any data: inertia falls with k (up to 5 %),
    indices are in range, principal components are ordered and uncorrelated, and
    topics list distinct terms by falling weight."""
    rows = sorted(kmeans_sweep(spark, sf).collect(), key=lambda r: r["k"])
    falls = all(b["inertia"] <= a["inertia"] * 1.05 for a, b in zip(rows, rows[1:]))
    pc = pca2(spark, sf)
    v = pc.agg(F.count("*").alias("n"), F.var_pop("pc1").alias("a"), F.var_pop("pc2").alias("b"), F.covar_pop("pc1", "pc2").alias("c")).first()
    topics = lda_topics(spark, sf).collect()
    by_topic = {t: sorted((r["rank"], r["weight"], r["term"]) for r in topics if r["topic"] == t) for t in {r["topic"] for r in topics}}
    ordered = all([r[0] for r in x] == list(range(1, 9)) and [r[1] for r in x] == sorted((r[1] for r in x), reverse=True) and len({r[2] for r in x}) == 8 for x in by_topic.values())
    return spark.createDataFrame([(len(rows), falls, all(-1 <= r["silhouette"] <= 1 for r in rows), all(r["davies_bouldin"] > 0 and r["calinski_harabasz"] > 0 for r in rows),
                                   v["n"], v["a"] >= v["b"] > 0, abs(v["c"]) <= 1e-4 * (v["a"] * v["b"]) ** 0.5, len(topics), ordered)],
                                 "ks long, inertia_falls boolean, silhouette_in_range boolean, indices_positive boolean, pca_rows long, pca_ordered boolean, pca_orthogonal boolean, "
                                 "topic_terms long, topics_ordered boolean")
