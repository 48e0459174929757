"""Queries: cleaning, filters and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import clean as C
from textlake.plans.registry import register
from textlake.plans.sqlviews import with_ctes
from textlake.sources import views as V

REVIEW_COLS = ["review_id", "text", "rating", "parent_asin", "verified_purchase", "helpful_vote"]


@register("drop_nulls", "clean", with_ctes(
    "SELECT review_id, text, rating FROM reviews WHERE text IS NOT NULL AND rating IS NOT NULL", "reviews"))
def drop_nulls(spark, sf):
    return C.drop_nulls(V.reviews(spark, sf), ["text", "rating"]).select("review_id", "text", "rating")


@register("verified_only", "clean", with_ctes(
    "SELECT review_id, rating, parent_asin FROM reviews WHERE verified_purchase", "reviews"))
def verified_only(spark, sf):
    return C.verified_only(V.reviews(spark, sf)).select("review_id", "rating", "parent_asin")


@register("min_chars", "clean", with_ctes(
    "SELECT review_id, CAST(length(text) AS BIGINT) AS n_chars FROM reviews WHERE length(text) > 20", "reviews"))
def min_chars(spark, sf):
    return C.min_chars(V.reviews(spark, sf)).select("review_id", F.length("text").cast("bigint").alias("n_chars"))


@register("min_words_space", "clean", with_ctes(
    "SELECT review_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words FROM reviews "
    "WHERE len(string_split(text, ' ')) >= 5", "reviews"))
def min_words_space(spark, sf):
    from textlake.functions.text import words_space
    return C.min_words_space(V.reviews(spark, sf)).select("review_id", words_space("text").alias("n_words"))


_WS_SQL = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''))"


@register("min_words_ws", "clean", with_ctes(
    f"SELECT review_id, CAST({_WS_SQL} AS BIGINT) AS n_words FROM reviews WHERE {_WS_SQL} >= 5", "reviews"))
def min_words_ws(spark, sf):
    from textlake.functions.text import words_ws
    return C.min_words_ws(V.reviews(spark, sf)).select("review_id", words_ws("text").alias("n_words"))


@register("non_blank", "clean", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def non_blank(spark, sf):
    from textlake.sources.tables import read_table
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return C.non_blank(conv).select("conv_id", "turn")


@register("dedupe_text", "clean", with_ctes(
    "SELECT review_id, rating, parent_asin FROM (SELECT *, row_number() OVER "
    "(PARTITION BY text ORDER BY review_id) AS rn FROM reviews) WHERE rn = 1", "reviews"))
def dedupe_text(spark, sf):
    r = V.reviews(spark, sf).select("review_id", "text", "rating", "parent_asin")
    return C.dedupe_text(r).select("review_id", "rating", "parent_asin")


@register("dedupe_key", "clean", with_ctes(
    "SELECT parent_asin, min(main_category) AS main_category FROM "
    "(SELECT CAST(CAST(parent_asin AS BIGINT) % 50 AS VARCHAR) AS parent_asin, main_category FROM products) "
    "GROUP BY parent_asin", "products"))
def dedupe_key(spark, sf):
    # fold 200 products onto 50 keys so every key has copies to remove
    p = V.products(spark, sf).select(
        (F.col("parent_asin").cast("bigint") % 50).cast("string").alias("parent_asin"), "main_category")
    return C.dedupe_key(p, "parent_asin")


@register("dedupe_keep_best", "clean", with_ctes(
    "SELECT main_category, review_id, score FROM (SELECT *, row_number() OVER (PARTITION BY main_category "
    "ORDER BY score DESC, review_id) AS rn FROM (SELECT main_category, CAST(parent_asin AS BIGINT) AS review_id, "
    "CAST(CAST(parent_asin AS BIGINT) % 7 AS DOUBLE) AS score FROM products)) WHERE rn = 1", "products"))
def dedupe_keep_best(spark, sf):
    # stand-in for "per model name keep the best F1": per brand keep the best score
    p = V.products(spark, sf).select("main_category", F.col("parent_asin").cast("bigint").alias("review_id"),
                                     (F.col("parent_asin").cast("bigint") % 7).cast("double").alias("score"))
    return C.dedupe_keep_best(p, "main_category", "score", "review_id").select("main_category", "review_id", "score")


@register("clean_reviews", "clean", with_ctes(
    "SELECT review_id, rating, parent_asin, main_category, CAST(length(text) AS BIGINT) AS n_chars FROM clean",
    "clean"))
def clean_reviews(spark, sf):
    c = C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))
    return c.select("review_id", "rating", "parent_asin", "main_category",
                    F.length("text").cast("bigint").alias("n_chars"))
