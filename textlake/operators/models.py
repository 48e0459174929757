"""Supervised models, model search, importances, stacking.

All learners are MLlib estimators (distributed training, no collect of the
training data). Evaluation uses the macro scores of ``operators.evaluate``
(MLlib's "f1" metric is the weighted F1). Class imbalance is handled with a
per-row ``weightCol`` = n / (k * n_c), the balanced weighting.
"""

from __future__ import annotations

import functools
import importlib
import math
import time

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textlake.functions import labels as L
from textlake.operators import boost as BO
from textlake.operators import encode as EN
from textlake.operators import evaluate as EV
from textlake.operators import features as FE
from textlake.operators import forest as FO
from textlake.operators import sampling as S
from textlake.operators import text as TX
from textlake.session import discard, materialize, release, staged

K = 3
#: Fixed value: the tolerance at which the linear models stop before their last iteration.
TOLERANCE = 1e-4
#: Share of the rows that a tree draws where a query takes the reference's ``max_samples``.
MAX_SAMPLES = 0.05


def supervised_frame(clean: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """review_id, label (0/1/2), terms array, 9 features, class weight, split.
    With ``texts`` (text_key, text), ``clean`` has the key only and the texts are
    moved once, after the split. Tokens are written, once a row and compressed;
    the terms, three times their size, are made of them by who reads them."""
    if texts is not None:
        clean = staged(clean)  # read by the weights and by both passes of the split
    f = S.train_test_split(with_balanced_weights(clean.withColumn("label", L.sentiment_class("rating")), "label"), "label")
    f = f.repartition(F.xxhash64("review_id", "text")) if texts is None else f.join(texts, "text_key").drop("text_key")
    f = FE.text_features(f).withColumn("tokens", F.array_join(TX.word_tokens("text", TX.english_stop_words()), " ")).drop("text")
    f = staged(f)
    release(f.sparkSession)
    f = f.withColumn("_tok", F.when(F.col("tokens") == "", F.array().cast("array<string>")).otherwise(F.split("tokens", " ")))
    return f.select(*[c for c in f.columns if c != "_tok"], F.concat("_tok", TX.bigrams(F.col("_tok"))).alias("terms"))


def with_balanced_weights(f: DataFrame, cls: str = "label") -> DataFrame:
    """Add ``w`` = n / (k * n_c). The per-class counts are a k-row aggregate
    (map-side combined), so broadcasting them is bounded by the class count; a
    join by class would put a class, and so most rows, into one task."""
    counts = f.groupBy(cls).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()
    counts = counts.select(cls, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc"))).alias("w"))
    return f.join(F.broadcast(counts), cls, "inner")


def fit_features(train: DataFrame, vocab: int = 10_000, min_df: int = 5) -> PipelineModel:
    """V4: the TF-IDF weights of V1 (smooth idf + 1, L2-normalized rows) beside
    the scaled features of V3 (population deviation), fitted on ``train``."""
    top, n = TX.top_ngrams(train, "tokens", vocab, min_df) if "tokens" in train.columns else TX.top_terms(train, vocab, min_df), train.count()
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in top], inputCol="terms", outputCol="tf")
    idf = [math.log((n + 1) / (r["df"] + 1)) + 1.0 for r in top]  # the rows of each term are known
    weights = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="_weights")
    unit = Normalizer(inputCol="_weights", outputCol="text_features", p=2.0)
    return PipelineModel([counts, weights, unit, *_scaled(train).stages, VectorAssembler(inputCols=["text_features", "num"], outputCol="features")])


def fit_embedding_features(train: DataFrame) -> PipelineModel:
    """The L2-normalized embedding beside the nine scaled features."""
    unit = Normalizer(inputCol="emb_vec", outputCol="emb_unit", p=2.0)
    return PipelineModel([ArrayToVector(), unit, *_scaled(train).stages, VectorAssembler(inputCols=["emb_unit", "num"], outputCol="features")])


def _scaled(train: DataFrame) -> PipelineModel:
    """V3: (x - mean) / population deviation of the engineered features."""
    n = train.count()
    raw = VectorAssembler(inputCols=FE.FEATURES, outputCol="num_raw")
    scaler = StandardScaler(inputCol="num_raw", outputCol="_num", withMean=True, withStd=True).fit(raw.transform(train))
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0  # MLlib divides by the sample deviation
    return PipelineModel([raw, scaler, ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(FE.FEATURES)), inputCol="_num", outputCol="num")])


def penalty(train: DataFrame, C: float) -> float:
    """The L2 penalty of strength C: losses are averaged by weight here and
    summed there, so it is 1 / (C * sum of weights)."""
    return 1.0 / (C * train.agg(F.sum("w")).first()[0])


def logreg(C: float = 1.0, max_iter: int = 1000):
    """L1: multinomial, balanced weights."""
    return lambda train: LogisticRegression(family="multinomial", weightCol="w", regParam=penalty(train, C),
                                            elasticNetParam=0.0, maxIter=max_iter, tol=TOLERANCE, standardization=False)


def random_forest(n_trees: int = 100, depth: int = 30, rate: float = 1.0, min_leaf: int = 1, seed: int = 42):
    """L2: every tree draws as many rows as there are, with replacement; ``rate`` makes it draw a share of that."""
    return lambda train: FO.DeepForestClassifier(numTrees=n_trees, maxDepth=depth, subsamplingRate=rate, minInstancesPerNode=min_leaf,
                                                 featureSubsetStrategy="sqrt", weightCol="w", seed=seed)


def linear_svc_ovr(C: float = 0.5, max_iter: int = 2000):
    """L4. One class after the other: every fit keeps a copy of the rows, in memory or on disk."""
    return lambda train: OneVsRest(classifier=LinearSVC(regParam=penalty(train, C), maxIter=max_iter, tol=TOLERANCE, weightCol="w"), weightCol="w", parallelism=1)


class BoostedOneVsRest:
    """L3: boosted trees are binary, so one model per class, up to ``iters``
    rounds each (``boost``: MLlib's method, all classes in one pass over sparse
    rows); boosting stops when the error on the validation rows (a fifth of the
    training rows, by hash) no longer falls. The class of the largest
    probability is predicted."""

    def __init__(self, iters: int = 300, depth: int = 5, step: float = 0.1, rate: float = 0.8, seed: int = 42, tol: float = 0.001):
        self.model = BO.Booster(K, maxIter=iters, maxDepth=depth, stepSize=step, subsamplingRate=rate, seed=seed, validationTol=tol)

    def fit(self, train: DataFrame):
        self.model.fit(train.select("features", "label", "w", S.hash_fraction_below("review_id", 0.2, 7).alias("held")))
        return self

    def rounds(self) -> list[int]:
        return [len(t) for t in self.model.trees]

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("_p", F.transform(self.model.margins(df), lambda m: 1 / (1 + F.exp(-2 * m))))
        total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p)
        df = df.withColumn("proba", F.zip_with("_p", F.array_repeat(total, K), lambda p, t: p / t)).drop("_p")
        return df.withColumn("prediction", (F.array_position("proba", F.array_max("proba")) - 1).cast("double"))


def boosted_ovr(**args):
    return lambda train: BoostedOneVsRest(**args)


def metrics_row(pred: DataFrame, name: str, seconds: float) -> DataFrame:
    counts = EV.confusion_counts(pred.withColumn("pred", F.col("prediction").cast("int")), [])
    m = EV.macro_metrics(counts, [], K)
    return m.select(F.lit(name).alias("model_name"), F.lit(round(seconds, 3)).alias("training_time_seconds"),
                    "accuracy", "precision_macro", "recall_macro", "f1_macro", "n")


def fit_evaluate(frame: DataFrame, make, name: str, features=fit_features):
    """Fit features and model on the train rows, score the test rows. Returns
    (features, model, metrics row); the time is that of the model's fit."""
    train, test = frame.where(F.col("split") == "train"), frame.where(F.col("split") == "test")
    prepare = features(train)
    x = staged(prepare.transform(train).select("review_id", "label", "w", "features"))
    release(x.sparkSession)
    t0 = time.time()
    model = make(x).fit(x)
    secs = time.time() - t0
    discard(x)
    return prepare, model, metrics_row(model.transform(prepare.transform(test)), name, secs)


def probabilities(pred: DataFrame):
    """The class probabilities as an array, whatever the model gives."""
    return F.col("proba") if "proba" in pred.columns else vector_to_array("probability")


def search_estimators() -> dict:
    """The estimators that the search compares unless others are given."""
    return {"logreg": logreg(), "random_forest": random_forest(rate=MAX_SAMPLES), "random_forest_leaf4": random_forest(rate=MAX_SAMPLES, min_leaf=4), "gbt_ovr": boosted_ovr()}


def model_search(frame: DataFrame, estimators: dict | None = None) -> DataFrame:
    """Macro F1 of several estimators on a fifth of the train rows, each
    with its own time; the best first."""
    train = frame.where(F.col("split") == "train")
    held = S.hash_fraction_below("review_id", 0.2, 11)
    parts = train.withColumn("split", F.when(held, F.lit("test")).otherwise(F.lit("train")))
    prepare = fit_features(parts.where("split = 'train'"))
    x = staged(prepare.transform(parts).select("review_id", "label", "w", "features", "split"))
    rows = []
    for name, make in (estimators or search_estimators()).items():
        fit_on = x.where("split = 'train'")
        t0 = time.time()
        model = make(fit_on).fit(fit_on)
        secs = time.time() - t0
        score = metrics_row(model.transform(x.where("split = 'test'")), name, secs).first()
        rows.append((name, float(score["f1_macro"]), round(secs, 3)))
        release(frame.sparkSession)
    discard(x)
    rows.sort(key=lambda r: (-r[1], r[0]))
    return frame.sparkSession.createDataFrame(rows, "estimator string, macro_f1 double, time_to_fit double")


def grouped_importance(model, block: str = "text_block") -> list[tuple[str, float]]:
    """Importances summed over the block of text (or embedding) features vs each engineered feature."""
    imp = importances(model)
    n_num = len(FE.FEATURES)
    return [(block, float(imp[:-n_num].sum()))] + [(f, float(v)) for f, v in zip(FE.FEATURES, imp[-n_num:])]


def importances(model):
    """Importance per feature: that of the trees, or the mean absolute coefficient over the classes."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    return abs(model.coefficientMatrix.toArray()).mean(axis=0)


def top_terms(prepare: PipelineModel, model, n: int = 15) -> list[tuple[str, float]]:
    """The ``n`` features of largest importance, by term or feature name (ties by name)."""
    names = [*prepare.stages[0].vocabulary, *FE.FEATURES]
    return sorted(((t, float(v)) for t, v in zip(names, importances(model))), key=lambda x: (-x[1], x[0]))[:n]


def stacking(frame: DataFrame, base: dict, folds: int = 3) -> DataFrame:
    """Multinomial regression on the base models' class probabilities.

    The train rows' probabilities are out of fold: every row is scored by
    models that have not seen it. The test rows are scored by models of all
    train rows."""
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    fold = F.pmod(F.xxhash64("review_id"), F.lit(folds))
    t0 = time.time()

    def scored(fit_on: DataFrame, rows: DataFrame) -> DataFrame:
        prepare = fit_features(fit_on)
        x = staged(prepare.transform(fit_on).select("review_id", "label", "w", "features"))
        release(x.sparkSession)
        out = prepare.transform(rows).select("review_id", "label", "w", "features")
        for name, make in base.items():
            pred = make(x).fit(x).transform(out)
            out = pred.withColumn(name, probabilities(pred)).select(*out.columns, name)
            release(x.sparkSession)
        out = staged(out.drop("features"))
        discard(x)
        return out

    parts = [scored(train.where(fold != f), train.where(fold == f)) for f in range(folds)]
    meta_train = functools.reduce(DataFrame.unionByName, parts)
    meta_test = scored(train, test)
    flat = lambda d: d.select("review_id", "label", "w", *[F.get(m, i).alias(f"{m}_{i}") for m in base for i in range(K)])
    cols = [f"{m}_{i}" for m in base for i in range(K)]
    meta_train = flat(meta_train)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), logreg()(meta_train)])
    model = pipe.fit(meta_train)
    return metrics_row(model.transform(flat(meta_test)), "stacking", time.time() - t0)


def embedding_frame(clean: DataFrame, encode) -> DataFrame:
    """review_id, label, 9 features, embedding array, class weight, split (80/20).

    ``encode`` is any DataFrame job (id, text) -> (id, embedding)."""
    clean = staged(clean.select("review_id", "text", "rating"))  # read by the encoder and by the features
    emb = encode(clean.select("review_id", "text"))
    f = FE.text_features(clean).select("review_id", L.sentiment_class("rating").alias("label"), *FE.FEATURES).join(emb, "review_id", "inner")
    f = staged(f)  # read by the weights and by both passes of the split
    return materialize(S.train_test_split(with_balanced_weights(f, "label"), "label"))


class ArrayToVector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: ``embedding`` array<double> -> ``emb_vec`` ML vector."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("emb_vec", array_to_vector("embedding"))


class TextEncoder(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: a text column -> the ML vector of its encoder, so that a
    saved model takes texts. ``encoder`` names the encoder's class as
    ``module:Class``; it is made with ``dim``. Both are saved with the model."""

    encoder = Param(Params._dummy(), "encoder", "class of the encoder, module:Class", TypeConverters.toString)
    dim = Param(Params._dummy(), "dim", "dimension of the vectors", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="emb_vec", encoder="textlake.operators.encode:HashEncoder", dim=256):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="emb_vec", encoder="textlake.operators.encode:HashEncoder", dim=256)
        self._set(**self._input_kwargs)

    def make(self):
        module, name = self.getOrDefault(self.encoder).split(":")
        return getattr(importlib.import_module(module), name)(self.getOrDefault(self.dim))

    def _transform(self, df: DataFrame) -> DataFrame:
        encoded = EN.encode_batches(df, self.make(), self.getInputCol(), "_encoded")
        return encoded.withColumn(self.getOutputCol(), array_to_vector("_encoded")).drop("_encoded")


def text_frame(clean: DataFrame) -> DataFrame:
    """review_id, text, label, class weight, split (80/20)."""
    f = clean.select("review_id", "text", L.sentiment_class("rating").alias("label"))
    return materialize(S.train_test_split(with_balanced_weights(f, "label"), "label"))


def text_classifier(train: DataFrame, C: float = 1.0, max_iter: int = 1000, dim: int = 256) -> Pipeline:
    """L1 on embeddings, from text: encode, L2-normalize and classify in one pipeline that can be saved."""
    return Pipeline(stages=[TextEncoder(dim=dim), Normalizer(inputCol="emb_vec", outputCol="features", p=2.0), logreg(C, max_iter)(train)])


def embedding_classifier(train: DataFrame, C: float = 1.0, max_iter: int = 1000) -> Pipeline:
    """L1 on embeddings: array -> vector, L2-normalize *inside* the pipeline
    (so scoring normalizes exactly like training, SURVEY 8 #1), multinomial
    logistic regression with balanced weights."""
    return Pipeline(stages=[ArrayToVector(), Normalizer(inputCol="emb_vec", outputCol="features", p=2.0), logreg(C, max_iter)(train)])


class MacroF1(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """2.17: macro F1 as a tuning metric (MLlib's own "f1" is weighted by class size)."""

    @keyword_only
    def __init__(self, *, labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(F.col(self.getLabelCol()).cast("int").alias("label"), F.col(self.getPredictionCol()).cast("int").alias("pred"))
        return float(EV.macro_metrics(EV.confusion_counts(rows, []), [], K).first()["f1_macro"])


def tune(train: DataFrame, estimator, grid: list, seed: int = 42, parallelism: int = 2):
    """The grid point of largest macro F1 on a fifth of the rows, fitted on all
    of them. Returns (model, [(parameters by name, macro F1)])."""
    search = TrainValidationSplit(estimator=estimator, estimatorParamMaps=grid, evaluator=MacroF1(), trainRatio=0.8, seed=seed, parallelism=parallelism)
    found = search.fit(train)
    return found.bestModel, [({p.name: v for p, v in point.items()}, f) for point, f in zip(grid, found.validationMetrics)]


def score_batch(model, df: DataFrame, labels: list[str], digits: int = 4) -> DataFrame:
    """Rows (encoded, or texts if the model encodes them) -> predicted class name and code, confidence (max
    probability) and the class -> probability map. One pass of
    ``model.transform``; everything after it is built-in expressions."""
    from textlake.functions import vectors as VF
    p = model.transform(df).withColumn("proba", vector_to_array("probability"))
    code = F.col("prediction").cast("int")
    names = F.array(*[F.lit(x) for x in labels])
    return p.select("review_id", F.element_at(names, code + 1).alias("sentiment"), code.alias("sentiment_code"),
                    VF.confidence("proba", digits).alias("confidence"),
                    VF.prob_map("proba", labels, digits).alias("probabilities"))
