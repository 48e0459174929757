"""Queries: sources/sinks round trips and metric-report analytics
(SURVEY 2.1, 2.15, L14).

Inputs are landed by Spark from the given tables (JSON lines, gzip CSV,
metric documents) in the session's checkpoint folder, then read back with the
reader under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import labels as L
from textlake.operators import clean as C
from textlake.operators import evaluate as EV
from textlake.operators import features as FE
from textlake.operators import reports as RP
from textlake.operators import sampling as S
from textlake.plans.registry import register
from textlake.plans.sqlviews import with_ctes
from textlake.session import materialize
from textlake.sources import io as IO
from textlake.sources import views as V
from textlake.sources.tables import read_table

_RAW = ["review_id", "rating", "title", "text", "parent_asin", "verified_purchase", "helpful_vote", "timestamp"]

def _more():
    """The raw fields that no later step uses, nested and textual ones among them."""
    return {"images": F.expr("array(named_struct('url', concat('img/', review_id)))"), "asin": F.concat(F.lit("a"), "parent_asin"),
            "user_id": F.concat(F.lit("u"), (F.col("review_id") % 97).cast("string")), "price": F.format_string("%.2f", F.col("review_id") % 50 / 4)}


def _landing(spark, sf, base):
    """JSON lines of the reviews, gzip-compressed, plus the conversation
    turns as non-JSON lines (malformed input for the PERMISSIVE reader)."""
    reviews = V.reviews(spark, sf).select(*_RAW).withColumns(_more())
    IO.write_jsonl(reviews, f"{base}/raw/reviews", "gzip")
    junk = read_table(spark, sf, "conversations", ["text"]) \
        .select(F.regexp_replace("text", "[\\r\\n]+", " ").alias("value")).where(F.trim("value") != "")
    junk.write.mode("overwrite").option("compression", "gzip").text(f"{base}/raw/junk")
    return f"{base}/raw/*"


@register("ingest_reviews", "io", with_ctes(
    "SELECT review_id, rating, parent_asin, \"timestamp\", '[{\"url\":\"img/' || review_id || '\"}]' AS images, 'a' || parent_asin AS asin, "
    "'u' || review_id % 97 AS user_id, printf('%.2f', review_id % 50 / 4) AS price FROM reviews", "reviews"))
def ingest_reviews(spark, sf):
    base = IO.scratch(spark, "ingest")
    good, _bad = IO.ingest_reviews(spark, _landing(spark, sf, base), f"{base}/parquet")
    return good.select("review_id", "rating", "parent_asin", "timestamp", "images", "asin", "user_id", "price")


@register("ingest_rejects", "io",
          "SELECT count(*) AS rejected FROM conversations WHERE trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) <> ''")
def ingest_rejects(spark, sf):
    base = IO.scratch(spark, "ingest")
    IO.ingest_reviews(spark, _landing(spark, sf, base), f"{base}/parquet")
    return IO.ingest_counts(spark, f"{base}/parquet").select("rejected")


@register("ingest_products", "io", with_ctes(
    r"""SELECT parent_asin, coalesce(nullif(regexp_extract(categories, '^\["[^"]+",\s*"([^"]+)"', 1), ''),
       'Categoría General') AS sub_categoria, main_category FROM products""", "products"))
def ingest_products(spark, sf):
    base = IO.scratch(spark, "products")
    p = V.products(spark, sf)
    # nested JSON on the way in: categories as a real array, details as an object
    nested = p.select("parent_asin", "title", "main_category", "price",
                      F.from_json("categories", "array<string>").alias("categories"),
                      F.struct(F.col("title").alias("name")).alias("details"))
    IO.write_jsonl(nested, f"{base}/raw")
    out = IO.ingest_products(spark, f"{base}/raw", f"{base}/parquet")
    from textlake.functions.text import sub_category
    return out.select("parent_asin", sub_category("categories").alias("sub_categoria"), "main_category")


@register("csv_roundtrip", "io", with_ctes(
    "SELECT review_id, md5(text) AS text_md5, rating FROM reviews", "reviews"))
def csv_roundtrip(spark, sf):
    base = IO.scratch(spark, "csv")
    r = V.reviews(spark, sf).select("review_id", "text", "rating")
    IO.write_csv(r, f"{base}/csv", gzip=True)
    back = IO.read_csv(spark, f"{base}/csv", r.schema, ["review_id", "text", "rating"])
    return back.select("review_id", F.md5("text").alias("text_md5"), "rating")


_TC = "CASE WHEN rating IN (1, 2) THEN 'Negativo' WHEN rating = 3 THEN 'Neutro' ELSE 'Positivo' END"


@register("write_canonical", "io", with_ctes(f"""
    SELECT review_id, rating, {_TC} AS target_class, char_total, total_tokens FROM (
      SELECT *, row_number() OVER (PARTITION BY rating ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'), review_id) AS rn
      FROM features)
    WHERE rn <= (SELECT least(500000, min(n)) FROM (SELECT count(*) AS n FROM features GROUP BY rating))""",
    "features"))
def write_canonical(spark, sf):
    base = IO.scratch(spark, "canonical")
    clean = C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))
    bal = S.balance_classes(clean, "rating", "review_id", 500_000)
    out = IO.write_canonical(FE.canonical(FE.text_features(bal)), f"{base}/canonical")
    return out.select("review_id", "rating", "target_class", "char_total", "total_tokens")


@register("stage_table", "io", with_ctes(
    "SELECT rating, count(*) AS n FROM clean GROUP BY rating", "clean"))
def stage_table(spark, sf):
    """Spill an intermediate (reliable checkpoint), continue from it."""
    clean = materialize(C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf)))
    return clean.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


@register("report_json", "io", with_ctes("""
    SELECT count(*) AS total_rows, CAST(count(*) FILTER (WHERE rating = 5) AS BIGINT) AS fives,
           CAST(count(*) FILTER (WHERE rating IN (1, 2)) AS BIGINT) AS negatives FROM features""", "features"))
def report_json(spark, sf):
    """The dataset report as one JSON document, read back and parsed."""
    base = IO.scratch(spark, "report")
    clean = C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))
    doc = RP.dataset_report(FE.canonical(FE.text_features(clean)))
    back = IO.write_report_json(doc, f"{base}/eda_summary").select(F.from_json("value", doc.schema).alias("d")).select("d.*")
    return back.select("total_rows", F.coalesce(F.col("rating_distribution")["5.0"], F.lit(0)).cast("long").alias("fives"),
                       F.coalesce(F.col("target_class_distribution")["Negativo"], F.lit(0)).cast("long").alias("negatives"))


@register("embedding_splits", "io", with_ctes("""
    SELECT review_id, label, CASE WHEN rn <= c0 THEN 'test' WHEN rn <= c0 + ((n - c0) * 176 + 999) // 1000 THEN 'val'
                                  ELSE 'train' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'), review_id) AS rn,
             count(*) OVER (PARTITION BY label) AS n, (count(*) OVER (PARTITION BY label) * 15 + 99) // 100 AS c0
      FROM unit_vectors)""", "unit_vectors"))
def embedding_splits(spark, sf):
    from textlake.operators.search import build_vector_index
    base = IO.scratch(spark, "splits")
    idx = build_vector_index(V.vectors(spark, sf), keep=["label"])
    IO.save_split_artifacts(S.train_val_test_split(idx, "label", "review_id"), f"{base}/emb")
    back = IO.load_embedding_splits(spark, f"{base}/emb")
    return back.select("review_id", "label", "split")


_SPLIT = """CASE WHEN rn <= c0 THEN 'test' WHEN rn <= c0 + ((n - c0) * 176 + 999) // 1000 THEN 'val' ELSE 'train' END"""


@register("split_artifacts", "io", with_ctes(f"""
    SELECT review_id, label, {_SPLIT} AS split, md5(text) AS text_md5, 256::BIGINT AS dimension, """ + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in FE.FEATURES) + f"""
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'), review_id) AS rn,
                 count(*) OVER (PARTITION BY label) AS n, (count(*) OVER (PARTITION BY label) * 15 + 99) // 100 AS c0
          FROM (SELECT *, CASE WHEN rating IN (1, 2) THEN 0 WHEN rating = 3 THEN 1 ELSE 2 END AS label FROM features))""", "features"))
def split_artifacts(spark, sf):
    """Per split the text, the label, the nine features and the text's embedding, written and read back."""
    from textlake.operators.encode import HashEncoder, encode_batches
    base = IO.scratch(spark, "artifacts")
    f = C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))
    f = S.train_val_test_split(f.select("review_id", "text", L.sentiment_class("rating").cast("int").alias("label")), "label", "review_id")
    f = FE.text_features(f).select("review_id", "text", "label", *FE.FEATURES, "split")  # made after the split, which deals out texts only
    IO.save_split_artifacts(encode_batches(f, HashEncoder()), f"{base}/artifacts")
    back = IO.load_embedding_splits(spark, f"{base}/artifacts")
    return back.select("review_id", "label", "split", F.md5("text").alias("text_md5"), F.size("embedding").cast("long").alias("dimension"),
                       *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FE.FEATURES])


@register("nested_as_text", "io", with_ctes(
    """SELECT parent_asin, replace(categories, '", "', '","') AS categories, '{"name":' || to_json(title) || '}' AS details FROM products""", "products"))
def nested_as_text(spark, sf):
    """X27 + S2: nested product fields become JSON text, are written so, and ingested as they are."""
    from textlake.functions.text import to_json_text
    base = IO.scratch(spark, "nested")
    nested = V.products(spark, sf).select("parent_asin", "title", "main_category", "price", F.from_json("categories", "array<string>").alias("categories"),
                                          F.struct(F.col("title").alias("name")).alias("details"))
    IO.write_jsonl(nested.withColumns({c: to_json_text(c) for c in ("categories", "details")}), f"{base}/raw")
    return IO.ingest_products(spark, f"{base}/raw", f"{base}/parquet").select("parent_asin", "categories", "details")


@register("predictions_roundtrip", "io", with_ctes(
    "SELECT model, review_id, label, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS pred FROM probs",
    "probs"))
def predictions_roundtrip(spark, sf):
    from textlake.operators.ensemble import hard_predictions
    base = IO.scratch(spark, "preds")
    IO.save_predictions(hard_predictions(V.probs(spark, sf)), f"{base}/preds")
    return IO.load_predictions(spark, f"{base}/preds").select("model", "review_id", "label", "pred")


@register("model_roundtrip", "io", "SELECT 0::BIGINT AS mismatches, true AS any_rows")
def model_roundtrip(spark, sf):
    """Save fitted features and model, load them, predictions must agree."""
    from pyspark.ml import PipelineModel
    from textlake.operators import models as M
    base = IO.scratch(spark, "model")
    reviews = V.reviews(spark, sf, text_key=True)
    frame = M.supervised_frame(C.clean_keys(reviews, V.products(spark, sf)), C.texts_by_key(reviews))
    prepare, model, _ = M.fit_evaluate(frame, M.random_forest(rate=M.MAX_SAMPLES), "random_forest")
    PipelineModel([prepare, model]).write().overwrite().save(f"{base}/model")
    loaded = PipelineModel.load(f"{base}/model")
    test = frame.where(F.col("split") == "test")
    a = model.transform(prepare.transform(test)).select("review_id", F.col("prediction").alias("saved"))
    b = loaded.transform(test).select("review_id", F.col("prediction").alias("loaded"))
    return a.join(b, "review_id", "full").agg(F.count_if(~F.col("saved").eqNullSafe(F.col("loaded"))).alias("mismatches"), (F.count("*") > 0).alias("any_rows"))


# ------------------------------------------------------------ E1-E7 -------
def _metric_docs(spark, sf):
    """Per-model metric documents built from the stored probabilities."""
    from textlake.operators.ensemble import hard_predictions
    preds = hard_predictions(V.probs(spark, sf))
    counts = EV.confusion_counts(preds, ["model"])
    macro = EV.macro_metrics(counts, ["model"])
    cm = EV.class_metrics(counts, ["model"])
    names = F.element_at(F.array(*[F.lit(x) for x in L.CLASS_LABELS]), F.col("cls") + 1)
    per = cm.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct(
        names, F.struct(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                        F.round("f1", 6).alias("f1"), F.col("support").cast("long").alias("support"))))).alias("per_class"))
    dense = EV.confusion_dense(counts, ["model"])
    mat = dense.groupBy("model").agg(F.array_sort(F.collect_list(F.struct(
        "label", F.array("pred_0", "pred_1", "pred_2").alias("row")))).alias("rows")) \
        .select("model", F.transform("rows", lambda r: r["row"]).alias("confusion_matrix"))
    seconds = F.when(F.col("model") != "m_b", F.round(F.col("accuracy") * 100, 6))  # one model without a training time
    return (macro.join(per, "model").join(mat, "model")
            .select(F.col("model").alias("model_name"), F.lit("probabilities").alias("model_type"),
                    seconds.alias("training_time_seconds"), "f1_macro", "precision_macro",
                    "recall_macro", "accuracy", "per_class", "confusion_matrix"))


def _reports(spark, sf):
    """Land the documents in the shapes that report files have: an array, a
    copy of it, a single object with the scores nested and the other name of
    the time, text that is no JSON, and a path that does not exist. Of
    documents of equal F1 the first file's, then the first in it, is kept."""
    base = IO.scratch(spark, "reports")
    docs = _metric_docs(spark, sf)
    objs = docs.where(F.col("model_name") != "m_c").select(F.to_json(F.struct(*docs.columns)).alias("j"))
    arr = materialize(objs.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")).alias("value")))
    for name in ("baseline", "baseline_copy"):
        arr.coalesce(1).write.mode("overwrite").text(f"{base}/{name}")
    scores = [c for c in docs.columns if c not in ("model_name", "model_type", "training_time_seconds")]
    one = docs.where(F.col("model_name") == "m_c").select(F.to_json(F.struct(
        "model_name", "model_type", F.struct(F.col("training_time_seconds").alias(IO.TIME_FIELDS[1]), *scores).alias(IO.NESTED))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(f"{base}/improved")
    broken = read_table(spark, sf, "region", ["r_name"]).agg(F.concat(F.lit("{no json "), F.max("r_name")).alias("value"))
    broken.coalesce(1).write.mode("overwrite").text(f"{base}/broken")
    rep = IO.load_metric_reports(spark, [f"{base}/{n}" for n in ("broken", "baseline", "missing", "baseline_copy", "improved")])
    return C.dedupe_keep_best(rep.withColumn("_seq", F.col("file") * 1_000_000 + F.col("pos")), "model_name", "f1_macro", "_seq")


_E = """
    cls AS (SELECT model, c.cls, sum(CASE WHEN label = c.cls AND pred = c.cls THEN n ELSE 0 END) AS tp,
                   sum(CASE WHEN label = c.cls THEN n ELSE 0 END) AS support,
                   sum(CASE WHEN pred = c.cls THEN n ELSE 0 END) AS predicted
            FROM cnt, (SELECT unnest([0, 1, 2]) AS cls) c GROUP BY model, c.cls),
    cp AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0.0) AS p,
                     coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS r FROM cls),
    cf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM cp),
    em AS (SELECT model AS model_name, round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro,
                  round(avg(f1), 6) AS f1_macro,
                  round((SELECT sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n) FROM cnt x
                         WHERE x.model = cf.model), 6) AS accuracy
           FROM cf GROUP BY model)"""


def _e_sql(body: str) -> str:
    pre = with_ctes("SELECT 1", "probs")
    ctes = pre[len("WITH "):pre.rindex("\nSELECT 1")]
    return ("WITH " + ctes + ",\n pr AS (SELECT model, review_id, label, "
            "CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS pred FROM probs),\n"
            " cnt AS (SELECT model, label, pred, count(*) AS n FROM pr GROUP BY ALL),\n" + _E + "\n" + body)


@register("report_models", "report", _e_sql("SELECT model_name, f1_macro, accuracy FROM em"))
def report_models(spark, sf):
    """Unified model list (duplicates across report files removed)."""
    return _reports(spark, sf).select("model_name", "f1_macro", "accuracy")


@register("report_metrics_long", "report", _e_sql(
    "SELECT model_name, metric, value FROM (UNPIVOT em ON f1_macro, precision_macro, recall_macro, accuracy "
    "INTO NAME metric VALUE value)"))
def report_metrics_long(spark, sf):
    """E2"""
    return RP.metrics_long(_reports(spark, sf))


@register("report_per_class", "report", _e_sql(
    "SELECT model AS model_name, ['Negativo', 'Neutro', 'Positivo'][cls + 1] AS cls, round(p, 6) AS precision, "
    "round(r, 6) AS recall, round(f1, 6) AS f1 FROM cf"))
def report_per_class(spark, sf):
    """E4"""
    return RP.per_class_rows(_reports(spark, sf))


@register("report_radar", "report", _e_sql("""
    SELECT e.model_name, e.f1_macro,
           max(CASE WHEN cls = 0 THEN round(f1, 6) END) AS Negativo,
           max(CASE WHEN cls = 1 THEN round(f1, 6) END) AS Neutro,
           max(CASE WHEN cls = 2 THEN round(f1, 6) END) AS Positivo
    FROM em e JOIN cf ON cf.model = e.model_name GROUP BY e.model_name, e.f1_macro"""))
def report_radar(spark, sf):
    """E5"""
    return RP.radar_rows(_reports(spark, sf))


@register("report_confusion_cells", "report", _e_sql("""
    SELECT m.model AS model_name, t.c AS true_code, p.c AS pred_code, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM (SELECT DISTINCT model FROM cnt) m, (SELECT unnest([0, 1, 2]) AS c) t, (SELECT unnest([0, 1, 2]) AS c) p
    LEFT JOIN cnt x ON x.model = m.model AND x.label = t.c AND x.pred = p.c"""))
def report_confusion_cells(spark, sf):
    """E6"""
    return RP.confusion_cells(_reports(spark, sf)).select("model_name", "true_code", "pred_code",
                                                         F.col("n").cast("bigint").alias("n"))


@register("report_f1_vs_time", "report", _e_sql(
    "SELECT model_name, f1_macro, round(accuracy * 100, 6) AS training_time_seconds FROM em WHERE model_name <> 'm_b'"))
def report_f1_vs_time(spark, sf):
    """Models without a training time are dropped."""
    return RP.f1_vs_time(_reports(spark, sf))


@register("track_run", "io", _e_sql(
    "SELECT 'search_eval' AS experiment, model_name AS run_name, '3' AS k, 'test' AS split, f1_macro, accuracy FROM em"))
def track_run(spark, sf):
    """One record per run with parameters, metrics and tags, all appended in one write."""
    base = IO.scratch(spark, "runs")
    m = EV.macro_metrics(EV.confusion_counts(
        V.probs(spark, sf).withColumn("pred", F.array_position("proba", F.array_max("proba")).cast("int") - 1),
        ["model"]), ["model"])
    runs = m.select(F.lit("search_eval").alias("experiment"), F.col("model").alias("run_name"), F.create_map(F.lit("k"), F.lit("3")).alias("params"),
                    F.create_map(F.lit("f1_macro"), F.col("f1_macro"), F.lit("accuracy"), F.col("accuracy")).alias("metrics"),
                    F.create_map(F.lit("split"), F.lit("test")).alias("tags"))
    back = IO.track_runs(runs, f"{base}/runs")
    return back.select("experiment", "run_name", F.col("params")["k"].alias("k"), F.col("tags")["split"].alias("split"),
                       *[F.col("metrics")[c].alias(c) for c in ("f1_macro", "accuracy")])
