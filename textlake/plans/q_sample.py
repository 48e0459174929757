"""Queries: sampling and splitting.

The oracle uses the textbook per-class ``row_number()`` window; the Spark side
uses the bucketed exact rank of ``operators.sampling``. Equal results show the
bucketed form is exact.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import labels as L
from textlake.operators import clean as C
from textlake.operators import sampling as S
from textlake.plans.registry import register
from textlake.plans.sqlviews import with_ctes
from textlake.sources import views as V

_K = "md5(CAST(review_id AS VARCHAR) || ':42')"
_TC = "CASE WHEN rating IN (1, 2) THEN 'Negativo' WHEN rating = 3 THEN 'Neutro' ELSE 'Positivo' END"


def _clean(spark, sf):
    return C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))


def _clean_tc(spark, sf):
    return _clean(spark, sf).withColumn("target_class", L.target_class("rating"))


@register("balance_classes", "sample", with_ctes(f"""
    SELECT review_id, rating FROM (
      SELECT review_id, rating, row_number() OVER (PARTITION BY rating ORDER BY {_K}, review_id) AS rn FROM clean)
    WHERE rn <= (SELECT least(500000, min(n)) FROM (SELECT count(*) AS n FROM clean GROUP BY rating))""", "clean"))
def balance_classes(spark, sf):
    return S.balance_classes(_clean(spark, sf).select("review_id", "rating"), "rating", "review_id", 500_000)


@register("sample_n", "sample", with_ctes(f"""
    SELECT review_id, rating FROM (SELECT review_id, rating, row_number() OVER (ORDER BY {_K}, review_id) AS rn
                                   FROM clean) WHERE rn <= 100""", "clean"))
def sample_n(spark, sf):
    return S.sample_n(_clean(spark, sf).select("review_id", "rating"), 100)


@register("sample_per_chunk", "sample", with_ctes(f"""
    SELECT review_id, rating FROM (
      SELECT review_id, rating, row_number() OVER (PARTITION BY floor(review_id / 100) ORDER BY {_K}, review_id) AS rn
      FROM clean) WHERE rn <= 15""", "clean"))
def sample_per_chunk(spark, sf):
    return S.sample_per_chunk(_clean(spark, sf).select("review_id", "rating"), "review_id", 100, 15)


_QC = ("CASE WHEN coalesce(rating, 0) <= 2 THEN 'negativo' WHEN rating = 3 THEN 'neutro' "
       "WHEN rating >= 4 THEN 'positivo' END")


@register("quota_head", "sample", with_ctes(f"""
    SELECT review_id, quota_class FROM (
      SELECT review_id, {_QC} AS quota_class,
             row_number() OVER (PARTITION BY {_QC} ORDER BY review_id) AS rn FROM reviews)
    WHERE rn <= 100 AND quota_class IS NOT NULL""", "reviews"))
def quota_head(spark, sf):
    r = V.reviews(spark, sf).select("review_id", L.quota_class("rating").alias("quota_class")) \
        .where(F.col("quota_class").isNotNull())
    return S.quota_head(r, "quota_class", "review_id", 100)


@register("stratified_subsample", "sample", with_ctes(f"""
    SELECT review_id, target_class FROM (
      SELECT c.review_id, c.target_class, q.quota,
             row_number() OVER (PARTITION BY c.target_class ORDER BY md5(CAST(c.review_id AS VARCHAR) || ':42'),
                                c.review_id) AS rn
      FROM tc c JOIN (
        SELECT target_class, fl + CASE WHEN r <= 500 - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM (
          SELECT target_class, (n * 500) // total AS fl,
                 row_number() OVER (ORDER BY (n * 500) % total DESC, target_class) AS r
          FROM (SELECT target_class, count(*) AS n, sum(count(*)) OVER () AS total FROM tc GROUP BY 1))
      ) q ON q.target_class = c.target_class)
    WHERE rn <= quota""", "clean", extra=[("tc", f"SELECT *, {_TC} AS target_class FROM clean")]))
def stratified_subsample(spark, sf):
    return S.stratified_subsample(_clean_tc(spark, sf).select("review_id", "target_class"), "target_class", 500)


def _split_sql(cuts: list[tuple[int, int]], names: list[str]) -> str:
    # cumulative cut positions per class, each share rounded up of what is left
    exprs, used = [], "0"
    for i, (num, den) in enumerate(cuts):
        size = f"(((n - ({used})) * {num} + {den - 1}) // {den})"
        used = f"({used} + {size})"
        exprs.append(f"{used} AS c{i}")
    case = " ".join(f"WHEN rn <= c{i} THEN '{names[i]}'" for i in range(len(cuts)))
    return f"""
    SELECT review_id, target_class, CASE {case} ELSE '{names[-1]}' END AS split FROM (
      SELECT t.review_id, t.target_class,
             row_number() OVER (PARTITION BY t.target_class ORDER BY md5(CAST(t.review_id AS VARCHAR) || ':42'),
                                t.review_id) AS rn, k.*
      FROM tc t JOIN (SELECT target_class AS tc_, {', '.join(exprs)} FROM
                      (SELECT target_class, count(*) AS n FROM tc GROUP BY 1)) k ON k.tc_ = t.target_class)"""


@register("split_80_20", "sample", with_ctes(
    _split_sql([(20, 100)], ["test", "train"]), "clean",
    extra=[("tc", f"SELECT *, {_TC} AS target_class FROM clean")]))
def split_80_20(spark, sf):
    return S.train_test_split(_clean_tc(spark, sf).select("review_id", "target_class"), "target_class")


@register("split_70_15_15", "sample", with_ctes(
    _split_sql([(15, 100), (176, 1000)], ["test", "val", "train"]), "clean",
    extra=[("tc", f"SELECT *, {_TC} AS target_class FROM clean")]))
def split_70_15_15(spark, sf):
    return S.train_val_test_split(_clean_tc(spark, sf).select("review_id", "target_class"), "target_class")


@register("equal_per_class", "sample", with_ctes(f"""
    SELECT review_id, target_class FROM (
      SELECT review_id, target_class,
             row_number() OVER (PARTITION BY target_class ORDER BY {_K}, review_id) AS rn FROM tc)
    WHERE rn <= 300 // 3""", "clean", extra=[("tc", f"SELECT *, {_TC} AS target_class FROM clean")]))
def equal_per_class(spark, sf):
    return S.equal_per_class(_clean_tc(spark, sf).select("review_id", "target_class"), "target_class", 300, 3)


@register("bernoulli", "sample", with_ctes(
    f"SELECT review_id FROM reviews WHERE substr({_K}, 1, 8) < '{format(int(round(0.3 * 2 ** 32)), '08x')}'",
    "reviews"))
def bernoulli(spark, sf):
    return S.bernoulli(V.reviews(spark, sf).select("review_id"), 0.3)


@register("shuffle_rows", "sample", with_ctes(
    f"SELECT review_id, row_number() OVER (ORDER BY {_K}, review_id) AS position FROM clean", "clean"))
def shuffle_rows(spark, sf):
    return S.shuffle_rows(_clean(spark, sf).select("review_id"))


@register("head_n", "sample", with_ctes(
    "SELECT review_id, rating FROM clean ORDER BY review_id LIMIT 50", "clean"))
def head_n(spark, sf):
    return S.head_n(_clean(spark, sf).select("review_id", "rating"), 50)
