"""Queries: scoring, evaluation and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import vectors as VF
from textlake.operators import ensemble as EN
from textlake.operators import evaluate as EV
from textlake.operators import sampling as S
from textlake.plans.registry import register
from textlake.plans.sqlviews import with_ctes
from textlake.sources import views as V

_PRED = ("pr", "SELECT model, review_id, label, proba, "
               "CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS pred FROM probs")
_CNT = ("cnt", "SELECT model, label, pred, count(*) AS n FROM pr GROUP BY ALL")


def _metrics_ctes(src: str, group: list[str], prefix: str) -> list[tuple[str, str]]:
    g = ", ".join(group)
    gsel = (g + ", ") if group else ""
    return [
        (f"{prefix}cls", f"""
        SELECT {gsel}c.cls,
               sum(CASE WHEN label = c.cls AND pred = c.cls THEN n ELSE 0 END) AS tp,
               sum(CASE WHEN label = c.cls THEN n ELSE 0 END) AS support,
               sum(CASE WHEN pred = c.cls THEN n ELSE 0 END) AS predicted
        FROM {src}, (SELECT unnest([0, 1, 2]) AS cls) c GROUP BY {gsel}c.cls"""),
        (f"{prefix}pr", f"""
        SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0.0) AS p,
                  coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS r FROM {prefix}cls"""),
        (f"{prefix}f", f"SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM {prefix}pr"),
        (f"{prefix}m", f"""
        SELECT {gsel}round(a.accuracy, 6) AS accuracy, round(avg(p), 6) AS precision_macro,
               round(avg(r), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro, a.n
        FROM {prefix}f JOIN (SELECT {gsel}sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n) AS accuracy,
                                    CAST(sum(n) AS BIGINT) AS n
                             FROM {src} {('GROUP BY ' + g) if group else ''}) a
             {('USING (' + g + ')') if group else 'ON true'}
        GROUP BY {gsel}a.accuracy, a.n"""),
    ]


def _preds(spark, sf):
    return EN.hard_predictions(V.probs(spark, sf))


def _counts(spark, sf):
    return EV.confusion_counts(_preds(spark, sf), ["model"])


@register("softmax_argmax", "score", with_ctes(
    "SELECT model, review_id, pred, round(list_max(proba), 6) AS confidence FROM pr", "probs", extra=[_PRED]))
def softmax_argmax(spark, sf):
    p = _preds(spark, sf)
    return p.select("model", "review_id", "pred", F.round(F.array_max("proba"), 6).alias("confidence"))


@register("confusion_matrix", "score", with_ctes("""
    SELECT m.model, c.label,
           CAST(coalesce(sum(n) FILTER (WHERE pred = 0), 0) AS BIGINT) AS pred_0,
           CAST(coalesce(sum(n) FILTER (WHERE pred = 1), 0) AS BIGINT) AS pred_1,
           CAST(coalesce(sum(n) FILTER (WHERE pred = 2), 0) AS BIGINT) AS pred_2
    FROM (SELECT DISTINCT model FROM cnt) m CROSS JOIN (SELECT unnest([0, 1, 2]) AS label) c
    LEFT JOIN cnt x ON x.model = m.model AND x.label = c.label
    GROUP BY m.model, c.label""", "probs", extra=[_PRED, _CNT]))
def confusion_matrix(spark, sf):
    return EV.confusion_dense(_counts(spark, sf), ["model"], 3)


@register("confusion_normalized", "score", with_ctes(
    "SELECT model, label, pred, round(n / sum(n) OVER (PARTITION BY model, label), 6) AS share FROM cnt",
    "probs", extra=[_PRED, _CNT]))
def confusion_normalized(spark, sf):
    return EV.confusion_normalized(_counts(spark, sf), ["model"])


@register("eval_metrics", "score", with_ctes(
    "SELECT * FROM em", "probs", extra=[_PRED, _CNT] + _metrics_ctes("cnt", ["model"], "e")))
def eval_metrics(spark, sf):
    return EV.macro_metrics(_counts(spark, sf), ["model"], 3)


@register("model_rank", "score", with_ctes("""
    SELECT model, metric, value, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS rank FROM (
      UNPIVOT em ON accuracy, precision_macro, recall_macro, f1_macro INTO NAME metric VALUE value)""",
    "probs", extra=[_PRED, _CNT] + _metrics_ctes("cnt", ["model"], "e")))
def model_rank(spark, sf):
    from textlake.operators.reports import model_rank as rank
    m = EV.macro_metrics(_counts(spark, sf), ["model"], 3)
    return rank(m.withColumnRenamed("model", "model_name")).withColumnRenamed("model_name", "model")


@register("weighted_vote", "score", with_ctes("""
    SELECT review_id, label, pred, round(score, 6) AS score FROM (
      SELECT review_id, label, pred, score,
             row_number() OVER (PARTITION BY review_id ORDER BY score DESC, pred) AS rk FROM (
        SELECT pr.review_id, pr.label, pr.pred, sum(em.f1_macro) AS score
        FROM pr JOIN em USING (model) GROUP BY pr.review_id, pr.label, pr.pred))
    WHERE rk = 1""", "probs", extra=[_PRED, _CNT] + _metrics_ctes("cnt", ["model"], "e")))
def weighted_vote(spark, sf):
    preds = _preds(spark, sf)
    weights = EV.macro_metrics(EV.confusion_counts(preds, ["model"]), ["model"], 3) \
        .select("model", F.col("f1_macro").alias("weight"))
    return EN.weighted_vote(preds, weights)


_MULTS = "[" + ", ".join(str(v) for v in EN.MULTIPLIERS) + "]"
_SOFT = ("soft", """
    SELECT review_id, label, list(p ORDER BY i) AS proba FROM (
      SELECT review_id, label, i, avg(proba[i + 1]) AS p FROM probs, range(0, 3) r(i) GROUP BY review_id, label, i)
    GROUP BY review_id, label""")
_SPLIT = ("sp", """
    SELECT s.*, CASE WHEN rn <= c0 THEN 'test' WHEN rn <= c0 + ((n - c0) * 176 + 999) // 1000 THEN 'val'
                     ELSE 'train' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'), review_id) AS rn,
             count(*) OVER (PARTITION BY label) AS n,
             (count(*) OVER (PARTITION BY label) * 15 + 99) // 100 AS c0 FROM soft) s""")
_GRID = ("gp", f"""
    SELECT m0, m1, m2, label,
           CAST(list_position(sc, list_max(sc)) - 1 AS INTEGER) AS pred FROM (
      SELECT g.m0, g.m1, g.m2, v.label, [v.proba[1] * g.m0, v.proba[2] * g.m1, v.proba[3] * g.m2] AS sc
      FROM (SELECT * FROM sp WHERE split = 'val') v,
           (SELECT CAST(a AS DOUBLE) AS m0, CAST(b AS DOUBLE) AS m1, CAST(c AS DOUBLE) AS m2
            FROM unnest({_MULTS}) t1(a), unnest({_MULTS}) t2(b), unnest({_MULTS}) t3(c)) g)""")
_GCNT = ("gcnt", "SELECT m0, m1, m2, label, pred, count(*) AS n FROM gp GROUP BY ALL")


def _soft_split(spark, sf):
    soft = EN.mean_probabilities(V.probs(spark, sf))
    return S.train_val_test_split(soft, "label", "review_id")


@register("threshold_grid", "score", with_ctes(
    "SELECT * FROM gm", "probs", extra=[_SOFT, _SPLIT, _GRID, _GCNT] + _metrics_ctes("gcnt", ["m0", "m1", "m2"], "g")))
def threshold_grid(spark, sf):
    sp = _soft_split(spark, sf)
    return EN.threshold_grid(sp.where(F.col("split") == "val"))


_BEST = ("best", "SELECT m0, m1, m2, f1_macro AS val_f1 FROM gm ORDER BY f1_macro DESC, m0, m1, m2 LIMIT 1")
_TEST = ("tp_", """
    SELECT t.label, CAST(list_position(sc, list_max(sc)) - 1 AS INTEGER) AS pred FROM (
      SELECT v.label, [v.proba[1] * b.m0, v.proba[2] * b.m1, v.proba[3] * b.m2] AS sc
      FROM (SELECT * FROM sp WHERE split = 'test') v, best b) t""")
_TCNT = ("tcnt", "SELECT label, pred, count(*) AS n FROM tp_ GROUP BY ALL")


@register("threshold_best", "score", with_ctes("""
    SELECT b.m0, b.m1, b.m2, b.val_f1, t.f1_macro AS test_f1, t.accuracy AS test_accuracy
    FROM best b, tm t""", "probs", extra=[_SOFT, _SPLIT, _GRID, _GCNT] + _metrics_ctes("gcnt", ["m0", "m1", "m2"], "g")
    + [_BEST, _TEST, _TCNT] + _metrics_ctes("tcnt", [], "t")))
def threshold_best(spark, sf):
    sp = _soft_split(spark, sf)
    grid = EN.threshold_grid(sp.where(F.col("split") == "val"))
    best = EN.best_thresholds(grid)
    test = EN.apply_thresholds(sp.where(F.col("split") == "test"), best)
    tm = EV.macro_metrics(EV.confusion_counts(test, []), [], 3)
    # one-row results combined through scalar subqueries (no join)
    return best.select("m0", "m1", "m2", F.col("f1_macro").alias("val_f1"),
                       tm.select("f1_macro").scalar().alias("test_f1"),
                       tm.select("accuracy").scalar().alias("test_accuracy"))


@register("argmax_confidence_map", "score", with_ctes("""
    SELECT model, review_id, ['Negativo', 'Neutro', 'Positivo'][pred + 1] AS sentiment, pred AS sentiment_code,
           round(list_max(proba), 4) AS confidence,
           map(['Negativo', 'Neutro', 'Positivo'], list_transform(proba, lambda x: round(x, 4))) AS probabilities
    FROM pr""", "probs", extra=[_PRED]))
def argmax_confidence_map(spark, sf):
    from textlake.functions import labels as L
    p = _preds(spark, sf)
    return p.select("model", "review_id", L.code_to_label("pred").alias("sentiment"), F.col("pred").alias("sentiment_code"),
                    VF.confidence("proba", 4).alias("confidence"),
                    VF.prob_map("proba", L.CLASS_LABELS, 4).alias("probabilities"))


_VOTE = ("vt", """
    SELECT review_id, label, pred FROM (
      SELECT review_id, label, pred, row_number() OVER (PARTITION BY review_id ORDER BY score DESC, pred) AS rk FROM (
        SELECT pr.review_id, pr.label, pr.pred, sum(em.f1_macro) AS score
        FROM pr JOIN em USING (model) GROUP BY pr.review_id, pr.label, pr.pred))
    WHERE rk = 1""")
_VCNT = ("vcnt", "SELECT label, pred, count(*) AS n FROM vt GROUP BY ALL")


@register("phase_comparison", "report", with_ctes("""
    SELECT model, 'individual' AS phase, f1_macro FROM em
    UNION ALL
    SELECT 'weighted_vote' AS model, 'ensemble' AS phase, f1_macro FROM vm""",
    "probs", extra=[_PRED, _CNT] + _metrics_ctes("cnt", ["model"], "e") + [_VOTE, _VCNT]
    + _metrics_ctes("vcnt", [], "v")))
def phase_comparison(spark, sf):
    """(model, phase, F1) across the individual models and the ensemble."""
    preds = _preds(spark, sf)
    per_model = EV.macro_metrics(EV.confusion_counts(preds, ["model"]), ["model"], 3)
    vote = EN.weighted_vote(preds, per_model.select("model", F.col("f1_macro").alias("weight")))
    vm = EV.macro_metrics(EV.confusion_counts(vote, []), [], 3)
    return per_model.select("model", F.lit("individual").alias("phase"), "f1_macro").unionByName(
        vm.select(F.lit("weighted_vote").alias("model"), F.lit("ensemble").alias("phase"), "f1_macro"))
