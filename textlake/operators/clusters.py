"""Clustering, projections, topics.

KMeans / LDA / LSH are MLlib estimators, the Gramian is that of MLlib's row matrix. Davies-Bouldin and
Calinski-Harabasz are computed from per-cluster aggregates joined with the
(k rows) centroid table -- no pairwise distances between points.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans, LDA
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window



def kmeans_scores(points: DataFrame, k: int, seed: int = 42) -> dict:
    """Fit KMeans and return inertia, silhouette (squared Euclidean, MLlib),
    Davies-Bouldin and Calinski-Harabasz (Euclidean)."""
    km = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=20)
    model = km.fit(points)
    pred = model.transform(points)
    sil = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(pred)
    spark = points.sparkSession
    cents = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
                                  "cluster int, c array<double>")  # k rows
    p = pred.select("cluster", vector_to_array("features").alias("x")).join(cents, "cluster")
    diff = F.zip_with("x", "c", lambda a, b: (a - b) * (a - b))
    p = p.withColumn("d2", F.aggregate(diff, F.lit(0.0), lambda s, v: s + v))
    per = p.groupBy("cluster").agg(F.avg(F.sqrt("d2")).alias("s"), F.count(F.lit(1)).alias("n"),
                                   F.sum("d2").alias("wss"))
    per = per.join(cents, "cluster").collect()  # k rows
    c = {r["cluster"]: np.array(r["c"]) for r in per}
    s = {r["cluster"]: r["s"] for r in per}
    n = {r["cluster"]: r["n"] for r in per}
    ids = sorted(c)
    db = 0.0
    for i in ids:
        db += max(((s[i] + s[j]) / max(np.linalg.norm(c[i] - c[j]), 1e-12)) for j in ids if j != i) if len(ids) > 1 else 0
    db /= max(len(ids), 1)
    total_n = sum(n.values())
    mean = sum(c[i] * n[i] for i in ids) / total_n
    bss = sum(n[i] * float(np.sum((c[i] - mean) ** 2)) for i in ids)
    wss = sum(r["wss"] for r in per)
    ch = (bss / max(len(ids) - 1, 1)) / (wss / max(total_n - len(ids), 1)) if wss > 0 else 0.0
    return {"k": k, "inertia": float(model.summary.trainingCost), "silhouette": float(sil),
            "davies_bouldin": float(db), "calinski_harabasz": float(ch)}


def kmeans_sweep(points: DataFrame, ks=range(2, 9), seed: int = 42) -> DataFrame:
    """C2"""
    rows = [kmeans_scores(points, k, seed) for k in ks]
    return points.sparkSession.createDataFrame(
        [(r["k"], r["inertia"], r["silhouette"], r["davies_bouldin"], r["calinski_harabasz"]) for r in rows],
        "k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double")


def cluster_top_terms(weights: DataFrame, assignments: DataFrame, n: int = 10, id_col: str = "review_id") -> DataFrame:
    """Mean TF-IDF weight per (cluster, term); top ``n`` terms per cluster."""
    j = weights.join(assignments.select(id_col, "cluster"), id_col)
    size = assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    agg = j.groupBy("cluster", "term").agg(F.sum("weight").alias("_s")).join(size, "cluster")
    agg = agg.withColumn("mean_weight", F.round(F.col("_s") / F.col("_n"), 6))
    w = Window.partitionBy("cluster").orderBy(F.col("mean_weight").desc(), F.col("term"))
    return agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .select("cluster", "rank", "term", "mean_weight")


def pca_project(points: DataFrame, k: int = 2, id_col: str = "review_id") -> DataFrame:
    """The rows, as they are, on the first axes of their covariance. That is made
    of the rows' Gramian, summed over their non-zero features only, and their means;
    MLlib's fit writes every row out to all features."""
    n, mean = points.select(Summarizer.metrics("count", "mean").summary(F.col("features")).alias("s")).select("s.count", "s.mean").first()
    if n < 2:
        raise ValueError(f"principal components need two rows, not {n}")
    mean = mean.toArray()
    gram = row_matrix(points).computeGramianMatrix().toArray()
    axes = np.linalg.svd((gram - n * np.outer(mean, mean)) / (n - 1))[0][:, :k]
    out = svd_project(points, axes, id_col)
    return out.select(id_col, *[F.round(f"s{i + 1}", 6).alias(f"pc{i + 1}") for i in range(k)])


def row_matrix(points: DataFrame):
    """The ``features`` as a distributed row matrix; rows go to it inside the JVM."""
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils
    return RowMatrix(MLUtils.convertVectorColumnsFromML(points.select("features"), "features"))


def svd_values(points: DataFrame, k: int = 3) -> DataFrame:
    """C4: top singular values of the (distributed) row matrix."""
    svd = row_matrix(points).computeSVD(k, computeU=False)
    vals = [float(x) for x in svd.s.toArray()]
    return points.sparkSession.createDataFrame([(i + 1, round(v, 6)) for i, v in enumerate(vals)],
                                               "component int, singular_value double")


def right_vectors(points: DataFrame, k: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(V, squared singular values, their total) of the ``features``: the Gramian is
    summed by the tasks; the driver gets (features x features) numbers, so the
    number of features, a vocabulary's, must be bounded. The largest component of
    each vector is positive."""
    gram = row_matrix(points).computeGramianMatrix().toArray()
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(values)[::-1][:k]
    v = vectors[:, top]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]), values[top], float(np.trace(gram))


def svd_project(points: DataFrame, v: np.ndarray, id_col: str = "review_id") -> DataFrame:
    """C4: (id, s1..sk), every row's coordinates on the right singular vectors; its
    non-zero features times the vectors' entries, in the JVM."""
    u = points.select(id_col, F.unwrap_udt("features").alias("f"))
    place = F.coalesce(F.col("f.indices"), F.sequence(F.lit(0), F.size("f.values") - 1))
    u = u.select(id_col, place.alias("i"), F.col("f.values").alias("x"))

    def on(vector) -> Column:
        entries = F.lit([float(c) for c in vector])
        return F.aggregate(F.zip_with("i", "x", lambda i, x: x * F.get(entries, i)), F.lit(0.0), lambda s, y: s + y)

    return u.select(id_col, *[on(v[:, j]).alias(f"s{j + 1}") for j in range(v.shape[1])])


def kmeans_best(points: DataFrame, k: int, starts: int = 10, seed: int = 42):
    """K-Means from several starts; (model of least inertia, inertia of every start)."""
    models = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster", maxIter=20).fit(points) for i in range(starts)]
    costs = [float(m.summary.trainingCost) for m in models]
    return models[int(np.argmin(costs))], costs


def lda_topics(counts: DataFrame, vocab: list[str], k: int = 5, n_terms: int = 8, seed: int = 42) -> DataFrame:
    """LDA topics with their top terms (vocabulary bounded by vocabSize)."""
    m = LDA(k=k, seed=seed, maxIter=20, featuresCol="features").fit(counts)
    t = m.describeTopics(n_terms)
    vb = counts.sparkSession.createDataFrame([(i, w) for i, w in enumerate(vocab)], "term_index int, term string")
    ex = t.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "tw"))
    ex = ex.select("topic", (F.col("rank") + 1).alias("rank"), F.col("tw.termIndices").alias("term_index"),
                   F.round(F.col("tw.termWeights"), 6).alias("weight"))
    return ex.join(vb, "term_index").select("topic", "rank", "term", "weight")


def ann_recall(index: DataFrame, queries: DataFrame, exact: DataFrame, k: int = 10,
               bucket_length: float = 1.3, tables: int = 4, seed: int = 42) -> DataFrame:
    """Approximate neighbours by random-projection LSH, recall@k against
    the exact search. One distributed job for all queries: the LSH
    similarity join pairs each query only with the corpus rows that share a
    hash bucket (the LSH candidates, never all pairs), the k nearest
    candidates per query are kept (``row_number() <= k``, partial limit
    before the shuffle) and compared with the exact hits by a join."""
    pts = index.select("review_id", array_to_vector("vec").alias("v"))
    qpts = queries.select(F.col("query_id").cast("long"), array_to_vector("vec").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length,
                                        numHashTables=tables, seed=seed).fit(pts)
    # unit (or zero) vectors are at most 2 apart: the threshold keeps every candidate
    pairs = model.approxSimilarityJoin(qpts, pts, 2.0 + 1e-6, distCol="dist").select(
        F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.review_id").alias("review_id"), "dist")
    w = Window.partitionBy("query_id").orderBy(F.col("dist"), F.col("review_id"))
    got = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("query_id", "review_id")
    want = exact.select(F.col("query_id").cast("long"), "review_id")
    n_got = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_returned"))
    n_want = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("_nw"))
    n_hit = got.join(want, ["query_id", "review_id"], "inner").groupBy("query_id").agg(F.count(F.lit(1)).alias("_nh"))
    out = qpts.select("query_id").join(n_want, "query_id", "left").join(n_got, "query_id", "left") \
        .join(n_hit, "query_id", "left")
    return out.select("query_id",
                      (F.coalesce(F.col("_nh"), F.lit(0)) / F.greatest(F.coalesce(F.col("_nw"), F.lit(0)), F.lit(1)))
                      .cast("double").alias("recall"),
                      F.coalesce(F.col("n_returned"), F.lit(0)).cast("int").alias("n_returned"))


def vectors_as_features(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec)))
