"""Projection, filters and deduplication.

Deduplication is written as an aggregation, not as a window over the key:
the partial (map-side) aggregate collapses copies before the shuffle, so a
text that occurs in a third of all rows costs one row per map task instead
of one giant window partition. The survivor is the row with the smallest
id (``min`` of a struct that starts with the id), which is deterministic and
independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T

MIN_CHARS = 20
MIN_WORDS = 5


def drop_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop a list of columns; absent names are ignored."""
    return df.drop(*cols)


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    """P2"""
    return df.dropna(subset=subset)


def verified_only(df: DataFrame) -> DataFrame:
    """``verified_purchase == True``; null is dropped."""
    return df.where(F.col("verified_purchase"))


def min_chars(df: DataFrame, n: int = MIN_CHARS) -> DataFrame:
    """Code-point length strictly above ``n``."""
    return df.where(F.length("text") > n)


def min_words_space(df: DataFrame, n: int = MIN_WORDS) -> DataFrame:
    """Single-space split, empty pieces counted."""
    return df.where(T.words_space("text") >= n)


def min_words_ws(df: DataFrame, n: int = MIN_WORDS) -> DataFrame:
    """Whitespace split (``str.split()``)."""
    return df.where(T.words_ws("text") >= n)


def non_blank(df: DataFrame) -> DataFrame:
    """P6"""
    return df.where(F.trim(F.col("text")) != "")


def keep_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``isin`` against a computed key list, as a semi join (no collect)."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def dedupe_first(df: DataFrame, key: list[str] | str, order_col: str = "review_id",
                 hash_key: bool = True) -> DataFrame:
    """One row per ``key``, the one with the smallest ``order_col``.

    ``hash_key`` adds ``xxhash64(key)`` in front of the grouping key so the
    sort-based aggregate compares 8-byte prefixes instead of long texts.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c != order_col]
    group: list[Column] = [F.col(k) for k in keys]
    if hash_key:
        group = [F.xxhash64(*keys).alias("_h")] + group
    best = F.min(F.struct(F.col(order_col), *[F.col(c) for c in rest])).alias("_best")
    out = df.groupBy(*group).agg(best)
    return out.select(*[F.col(k) for k in keys], F.col(f"_best.{order_col}"),
                      *[F.col(f"_best.{c}") for c in rest]).select(*df.columns)


def dedupe_text(df: DataFrame, order_col: str = "review_id") -> DataFrame:
    """``unique(subset=['text'])``; the row of the smallest id survives.

    One aggregate keyed by the text's SHA-256 digest, merged map-side, so copies
    of a text meet no window and no join. Null texts are one text, null ids come
    last, and of rows of one id and text one stays (the least row hash). The text
    is an aggregate of its own: who does not read it does not move it."""
    rest = [c for c in df.columns if c != "text"]
    order = F.struct(F.col(order_col).isNull(), F.col(order_col), F.xxhash64(*df.columns))
    keyed = df.select(F.sha2(F.col("text").cast("binary"), 256).alias("_d"), order.alias("_o"), F.struct(*rest).alias("_row"), "text")
    kept = keyed.groupBy("_d").agg(F.min_by("_row", "_o").alias("_row"), F.min_by("text", "_o").alias("text"))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_row.{c}").alias(c) for c in df.columns])


def clean_keys(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """P10 without the texts: the rows of ``clean_reviews`` with the text's SHA-256
    (``text_key``, made by the adapter) in its place, so that joins and the
    deduplication move 100 bytes a row. ``texts_by_key`` has the texts.

    Output: review_id, rating, parent_asin, text_key, main_category.
    """
    meta = drop_nulls(products, ["main_category"]).select("parent_asin", "main_category")
    r = min_words_space(min_chars(verified_only(drop_nulls(reviews, ["text", "rating"]))))
    rest = ["review_id", "rating", "parent_asin"]
    order = F.struct(F.col("review_id").isNull(), F.col("review_id"), F.xxhash64(*rest))
    kept = r.groupBy("text_key").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return kept.select(*[F.col(f"_row.{c}").alias(c) for c in rest], "text_key").join(meta, "parent_asin", "inner")


def texts_by_key(reviews: DataFrame) -> DataFrame:
    """(text_key, text): every text that passes the filters of P10, once."""
    r = min_words_space(min_chars(verified_only(drop_nulls(reviews, ["text", "rating"]))))
    return r.groupBy("text_key").agg(F.first("text").alias("text"))


def dedupe_key(df: DataFrame, key: str = "parent_asin") -> DataFrame:
    """One metadata row per key (smallest remaining columns win)."""
    others = [c for c in df.columns if c != key]
    best = F.min(F.struct(*[F.col(c) for c in others])).alias("_b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_b.{c}") for c in others])


def dedupe_keep_best(df: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """D3: per key keep the highest score; the first (lowest ``seq``) wins ties.

    ``max_by`` orders on (score, -seq) only, so the kept row may hold maps;
    it is one partial+final aggregate."""
    others = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in others]),
                    F.struct(F.col(score), (-F.col(seq)).alias("_q"))).alias("_b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_b.{c}") for c in others])


def clean_reviews(reviews: DataFrame, products: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """P10: P2 -> P3 -> P4 -> P5a -> D1 -> P1 -> J1. The reference filters by length
    after D1; all copies of a text pass or fail alike, so the rows are the same,
    and the text need not be moved for those who do not read it.

    Output: review_id, rating, text, parent_asin, timestamp, ``extra``, main_category.
    """
    meta = drop_nulls(products, ["main_category"]).select("parent_asin", "main_category")
    r = drop_nulls(reviews, ["text", "rating"])
    r = verified_only(r)
    r = r.select("review_id", "text", "rating", "parent_asin", "timestamp",
                 "verified_purchase", "helpful_vote", "title", *extra)
    r = min_chars(r)
    r = min_words_space(r)
    r = dedupe_text(r)
    r = drop_cols(r, ["verified_purchase", "helpful_vote", "title"])
    return r.join(meta, "parent_asin", "inner")
