"""Joins.

All joins are plain equi-joins; the physical strategy (broadcast hash vs
sort-merge) is left to Catalyst/AQE, which broadcasts a side only when its
runtime size is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
AQE skew-join splitting covers hot keys (an ASIN with a third of all
reviews).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators.clean import dedupe_key
from textlake.session import staged

#: Rows of one key that one task may join, keys and items of the sketch that finds larger ones.
PART_ROWS, HOT_KEYS, SKETCH_ITEMS = 20_000, 256, 4096


def join_products(reviews: DataFrame, products: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Inner join on parent_asin (projection pushed below the join)."""
    meta = products.select("parent_asin", *(cols or ["main_category"]))
    return reviews.join(meta, "parent_asin", "inner")


def join_with_suffixes(left: DataFrame, right: DataFrame, on: str,
                       suffixes: tuple[str, str] = ("_usuario", "_catalogo")) -> DataFrame:
    """Inner join; columns present on both sides get the suffixes."""
    common = (set(left.columns) & set(right.columns)) - {on}
    l2 = left.select(*[F.col(c).alias(c + suffixes[0]) if c in common else F.col(c) for c in left.columns])
    r2 = right.select(*[F.col(c).alias(c + suffixes[1]) if c in common else F.col(c) for c in right.columns])
    return l2.join(r2, on, "inner")


def enrich_category(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """J3 + X15: left join to deduplicated metadata, derive ``sub_categoria``."""
    meta = dedupe_key(products.select("parent_asin", "categories"), "parent_asin")
    return (reviews.join(meta, "parent_asin", "left")
            .withColumn("sub_categoria", T.sub_category("categories"))
            .drop("categories"))


def attach_timestamp(sample: DataFrame, raw: DataFrame, fanout: bool = False, key: str = "text") -> DataFrame:
    """Attach the raw timestamp.

    Default joins on ``review_id`` (one match). ``fanout=True`` reproduces the
    text join, where duplicated raw texts multiply the row; ``key`` may be a
    digest of the text that both sides have.
    """
    if fanout:
        return fan_out_join(sample.drop("timestamp"), raw.select(key, "timestamp"), key)
    return sample.drop("timestamp").join(raw.select("review_id", "timestamp"), "review_id", "left")


def hot_keys(df: DataFrame, digest: str, part_rows: int) -> list[str]:
    """Digests with more than ``part_rows`` rows by a frequent-items sketch, HOT_KEYS at most."""
    found = df.where(F.col(digest).isNotNull()).agg(F.expr(f"approx_top_k({digest}, {HOT_KEYS}, {SKETCH_ITEMS})").alias("top")).first()["top"]
    return [r["item"] for r in found or [] if r["count"] > part_rows]


def _grid(rows: DataFrame, hot: DataFrame, own: str, other: str) -> DataFrame:
    """Rows of hot keys with a cell (own part, other part): each row in one part of
    its side, once for each part of the other side."""
    rows = rows.join(F.broadcast(hot), "_d")  # 2 * HOT_KEYS rows at most
    rows = rows.withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(f"_n{own[1]}")).cast("int"))
    return rows.withColumn(other, F.explode(F.expr(f"sequence(0, _n{other[1]} - 1)"))).drop(f"_n{own[1]}", f"_n{other[1]}")


def fan_out_parts(left: DataFrame, right: DataFrame, key: str, part_rows: int):
    """(hot keys, left grid, right grid, cold left, cold right): a key with many rows
    on a side is cut into parts of about ``part_rows`` rows there, and every part
    of the one side meets every part of the other in a cell of its own."""
    digest = F.sha2(F.col(key).cast("binary"), 256)
    left, right = left.withColumn("_d", digest), right.withColumn("_d", digest)
    keys = sorted(set(hot_keys(left, "_d", part_rows)) | set(hot_keys(right, "_d", part_rows)))
    if not keys:
        return None, None, None, left, right
    sizes = [df.where(F.col("_d").isin(keys)).groupBy("_d").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias(n)) for df, n in ((left, "_ni"), (right, "_nj"))]
    hot = staged(sizes[0].join(sizes[1], "_d"))  # keys that both sides have
    is_hot = F.coalesce(F.col("_d").isin([r["_d"] for r in hot.select("_d").collect()]), F.lit(False))
    return hot, _grid(left, hot, "_i", "_j"), _grid(right, hot, "_j", "_i"), left.where(~is_hot), right.where(~is_hot)


def fan_out_join(left: DataFrame, right: DataFrame, key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Left join on ``key`` whose matches multiply. Keys hot on a side (found by a
    sketch) are joined by cells, so that a key with a third of both sides is
    spread over tasks; the others are joined plainly, all by the key's digest."""
    hot, grid_l, grid_r, cold_l, cold_r = fan_out_parts(left, right, key, part_rows)
    out = cold_l.join(cold_r.drop(key), "_d", "left").select(key, *[c for c in left.columns if c != key], *[c for c in right.columns if c != key])
    if hot is None:
        return out
    cells = grid_l.join(grid_r.drop(key), ["_d", "_i", "_j"]).drop("_d", "_i", "_j")  # equal SHA-256, equal key
    return out.unionByName(cells.select(*out.columns))


def products_in_reviews(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products whose key occurs in the reviews (semi join)."""
    return products.join(reviews.select("parent_asin"), "parent_asin", "left_semi")


def unreviewed_products(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products that no review mentions (anti join)."""
    return products.join(reviews.select("parent_asin"), "parent_asin", "left_anti")


def align_by_id(left: DataFrame, right: DataFrame, on: str = "review_id") -> DataFrame:
    """Re-attach columns by id instead of by position."""
    return left.join(right, on, "inner")
