"""Queries: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import labels as L
from textlake.functions import text as T
from textlake.operators import features as FE
from textlake.plans.registry import register
from textlake.plans.sqlviews import with_ctes
from textlake.sources import views as V

_WS = "[ \\t\\n\\r\\f\\x0B]"


def _clean(spark, sf):
    from textlake.operators.clean import clean_reviews
    return clean_reviews(V.reviews(spark, sf), V.products(spark, sf))


@register("text_counts", "scalar", with_ctes(
    "SELECT review_id, mayusculas_count, char_total, exclamacion_count, interrogacion_count, "
    "total_tokens, unique_types FROM features", "features"))
def text_counts(spark, sf):
    f = FE.text_features(_clean(spark, sf))
    return f.select("review_id", "mayusculas_count", "char_total", "exclamacion_count", "interrogacion_count",
                    "total_tokens", "unique_types")




@register("uppercase_pct", "scalar", with_ctes(
    "SELECT review_id, round(porcentaje_mayusculas, 6) AS porcentaje_mayusculas FROM features", "features"))
def uppercase_pct(spark, sf):
    f = FE.text_features(_clean(spark, sf))
    return f.select("review_id", F.round("porcentaje_mayusculas", 6).alias("porcentaje_mayusculas"))


@register("emotional_punct", "scalar", with_ctes(
    "SELECT review_id, puntuacion_emocional FROM features", "features"))
def emotional_punct(spark, sf):
    f = FE.text_features(_clean(spark, sf))
    return f.select("review_id", "puntuacion_emocional")


@register("ttr", "scalar", with_ctes("SELECT review_id, round(ttr, 6) AS ttr FROM features", "features"))
def ttr(spark, sf):
    f = FE.text_features(_clean(spark, sf))
    return f.select("review_id", F.round("ttr", 6).alias("ttr"))


_CLEANED_SQL = (f"coalesce(trim(regexp_replace(regexp_replace(lower(text), '[^a-z \\t\\n\\r\\f\\x0B]', '', 'g'), "
                f"'{_WS}+', ' ', 'g')), '')")


@register("text_cleaned", "scalar", with_ctes(
    f"SELECT review_id, {_CLEANED_SQL} AS text_cleaned, "
    f"CAST(len(list_filter(regexp_split_to_array({_CLEANED_SQL}, '{_WS}+'), lambda x: x <> '')) AS BIGINT) "
    f"AS text_length FROM reviews", "reviews"))
def text_cleaned(spark, sf):
    r = V.reviews(spark, sf)
    return r.select("review_id", T.text_cleaned("text").alias("text_cleaned"),
                    T.text_length("text").alias("text_length"))


@register("price_clean_zero", "scalar", with_ctes(
    "SELECT parent_asin, coalesce(TRY_CAST(regexp_replace(price, '[$,]', '', 'g') AS DOUBLE), 0.0) AS price_num "
    "FROM products", "products"))
def price_clean_zero(spark, sf):
    p = V.products(spark, sf)
    return p.select("parent_asin", T.price_num_zero("price").alias("price_num"))


@register("price_clean_median", "scalar", with_ctes("""
    SELECT parent_asin, round(coalesce(v, (SELECT median(v) FROM parsed)), 6) AS price_num FROM parsed""",
    "products", extra=[("parsed", "SELECT parent_asin, TRY_CAST(regexp_replace(price, '[^0-9.]', '', 'g') "
                                  "AS DOUBLE) AS v FROM products")]))
def price_clean_median(spark, sf):
    from textlake.operators.features import impute_median
    p = V.products(spark, sf).select("parent_asin", T.price_digits("price").alias("v"))
    return impute_median(p, "v").select("parent_asin", F.round("v", 6).alias("price_num"))


@register("sub_category", "scalar", with_ctes(
    r"""SELECT parent_asin, coalesce(nullif(regexp_extract(categories, '^\["[^"]+",\s*"([^"]+)"', 1), ''),
       'Categoría General') AS sub_categoria FROM products""", "products"))
def sub_category(spark, sf):
    return V.products(spark, sf).select("parent_asin", T.sub_category("categories").alias("sub_categoria"))


@register("calendar_parts", "scalar", with_ctes("""
    SELECT review_id, make_timestamp("timestamp" * 1000) AS fecha, month(make_timestamp("timestamp" * 1000)) AS mes,
           isodow(make_timestamp("timestamp" * 1000)) AS dia_semana,
           ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'][month(make_timestamp("timestamp" * 1000))]
             AS mes_nombre,
           ['Lun','Mar','Mie','Jue','Vie','Sab','Dom'][isodow(make_timestamp("timestamp" * 1000))] AS dia_nombre
    FROM reviews""", "reviews"))
def calendar_parts(spark, sf):
    r = V.reviews(spark, sf).withColumn("fecha", L.epoch_ms_to_ts("timestamp"))
    r = r.withColumn("mes", L.month_of("fecha")).withColumn("dia_semana", L.iso_weekday("fecha"))
    return r.select("review_id", F.col("fecha").cast("timestamp_ntz").alias("fecha"), "mes", "dia_semana",
                    L.month_name("mes").alias("mes_nombre"), L.weekday_name("dia_semana").alias("dia_nombre"))


@register("target_class", "scalar", with_ctes(
    "SELECT review_id, CASE WHEN rating IN (1, 2) THEN 'Negativo' WHEN rating = 3 THEN 'Neutro' "
    "ELSE 'Positivo' END AS target_class FROM reviews", "reviews"))
def target_class(spark, sf):
    return V.reviews(spark, sf).select("review_id", L.target_class("rating").alias("target_class"))


@register("sentiment_class", "scalar", with_ctes(
    "SELECT review_id, CAST(CASE WHEN rating <= 2 THEN 0 WHEN rating = 3 THEN 1 ELSE 2 END AS INTEGER) "
    "AS sentiment_class FROM reviews", "reviews"))
def sentiment_class(spark, sf):
    return V.reviews(spark, sf).select("review_id", L.sentiment_class("rating").alias("sentiment_class"))


@register("quota_class", "scalar", with_ctes(
    "SELECT review_id, CASE WHEN coalesce(rating, 0) <= 2 THEN 'negativo' WHEN rating = 3 THEN 'neutro' "
    "WHEN rating >= 4 THEN 'positivo' END AS quota_class FROM reviews", "reviews"))
def quota_class(spark, sf):
    return V.reviews(spark, sf).select("review_id", L.quota_class("rating").alias("quota_class"))


@register("label_code_roundtrip", "scalar", with_ctes("""
    SELECT review_id, code, ['Negativo', 'Neutro', 'Positivo'][code + 1] AS label FROM (
      SELECT review_id, CAST(CASE WHEN rating IN (1, 2) THEN 0 WHEN rating = 3 THEN 1 ELSE 2 END AS INTEGER) AS code
      FROM reviews)""", "reviews"))
def label_code_roundtrip(spark, sf):
    r = V.reviews(spark, sf).withColumn("code", L.label_to_code(L.target_class("rating")))
    return r.select("review_id", "code", L.code_to_label("code").alias("label"))


@register("snippet", "scalar", with_ctes(
    "SELECT review_id, left(text, 200) || '...' AS snippet FROM reviews", "reviews"))
def snippet(spark, sf):
    return V.reviews(spark, sf).select("review_id", T.snippet("text", 200).alias("snippet"))


@register("name_slug", "scalar", with_ctes(
    "SELECT parent_asin, replace(lower(title), ' ', '_') AS slug FROM products", "products"))
def name_slug(spark, sf):
    """Lower-case, spaces to underscores (file-name slugs)."""
    return V.products(spark, sf).select("parent_asin", T.slug("title").alias("slug"))
