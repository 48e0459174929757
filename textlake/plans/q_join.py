"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import clean as C
from textlake.operators import joins as J
from textlake.plans.registry import register
from textlake.plans.sqlviews import with_ctes
from textlake.session import staged
from textlake.sources import views as V


@register("join_products", "join", with_ctes(
    "SELECT r.review_id, r.parent_asin, p.main_category FROM reviews r JOIN products p "
    "ON p.parent_asin = r.parent_asin", "reviews", "products"))
def join_products(spark, sf):
    r = V.reviews(spark, sf).select("review_id", "parent_asin")
    return J.join_products(r, V.products(spark, sf))


@register("join_with_suffixes", "join", with_ctes(
    "SELECT r.review_id, r.parent_asin, r.title AS title_usuario, p.title AS title_catalogo, p.price "
    "FROM reviews r JOIN products p ON p.parent_asin = r.parent_asin", "reviews", "products"))
def join_with_suffixes(spark, sf):
    r = V.reviews(spark, sf).select("review_id", "parent_asin", "title")
    p = V.products(spark, sf).select("parent_asin", "title", "price")
    return J.join_with_suffixes(r, p, "parent_asin")


_ENRICH_SQL = r"""
    SELECT c.*, coalesce(nullif(regexp_extract(m.categories, '^\["[^"]+",\s*"([^"]+)"', 1), ''),
                         'Categoría General') AS sub_categoria
    FROM clean c LEFT JOIN (SELECT parent_asin, min(categories) AS categories FROM products
                            GROUP BY parent_asin) m ON m.parent_asin = c.parent_asin"""


@register("enrich_category", "join", with_ctes(
    "SELECT review_id, parent_asin, sub_categoria FROM enriched", "clean", "products",
    extra=[("enriched", _ENRICH_SQL)]))
def enrich_category(spark, sf):
    c = C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))
    return J.enrich_category(c, V.products(spark, sf)).select("review_id", "parent_asin", "sub_categoria")


@register("attach_timestamp", "join", with_ctes(
    "SELECT c.review_id, r.\"timestamp\" FROM clean c LEFT JOIN reviews r ON r.review_id = c.review_id",
    "clean", "reviews"))
def attach_timestamp(spark, sf):
    c = C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf)).select("review_id", "text")
    return J.attach_timestamp(c, V.reviews(spark, sf)).select("review_id", "timestamp")


@register("attach_timestamp_fanout", "join", with_ctes(
    "SELECT c.review_id, r.\"timestamp\" FROM clean c LEFT JOIN reviews r ON r.text = c.text",
    "clean", "reviews"))
def attach_timestamp_fanout(spark, sf):
    r = V.reviews(spark, sf, text_key=True)
    c = C.clean_reviews(r, V.products(spark, sf), extra=("text_key",)).select("review_id", "text_key")
    # both sides are read for their hot keys and for the join; without the texts they are small
    c, raw = staged(c), staged(r.select("text_key", "timestamp"))
    return J.attach_timestamp(c, raw, fanout=True, key="text_key").select("review_id", "timestamp")


@register("products_in_reviews", "join", with_ctes(
    "SELECT parent_asin, main_category FROM products p WHERE EXISTS "
    "(SELECT 1 FROM reviews r WHERE r.parent_asin = p.parent_asin)", "products", "reviews"))
def products_in_reviews(spark, sf):
    return J.products_in_reviews(V.products(spark, sf), V.reviews(spark, sf)).select("parent_asin", "main_category")


@register("unreviewed_products", "join", with_ctes(
    "SELECT parent_asin, main_category FROM products p WHERE NOT EXISTS "
    "(SELECT 1 FROM reviews r WHERE r.parent_asin = p.parent_asin)", "products", "reviews"))
def unreviewed_products(spark, sf):
    return J.unreviewed_products(V.products(spark, sf), V.reviews(spark, sf)).select("parent_asin", "main_category")


@register("align_by_id", "join", """
    SELECT d.doc_id AS review_id, l.quality, l.toxic, CAST(length(d.text) AS BIGINT) AS n_chars
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def align_by_id(spark, sf):
    from textlake.sources.tables import read_table
    d = read_table(spark, sf, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "review_id")
    lab = read_table(spark, sf, "labels", ["doc_id", "quality", "toxic"]).withColumnRenamed("doc_id", "review_id")
    return J.align_by_id(d.select("review_id", F.length("text").cast("bigint").alias("n_chars")), lab)
