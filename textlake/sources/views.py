"""Adapters that present the driver's test tables as the review corpus.

``reviews``  documents with the event of their id, if there is one:
             review_id, title, text, rating, parent_asin, verified_purchase,
             helpful_vote, timestamp (epoch ms), ts
``products`` all part rows: parent_asin, title, main_category, price (text),
             categories (JSON text)
``vectors``  embeddings scaled by 1 + vec_id % 3 (so normalization matters)
``probs``    three "models": softmax of embedding dims 1-3, 4-6, 7-9 with
             label = label % 3

The same definitions exist as SQL text in ``plans.sqlviews`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import vectors as V
from textlake.sources.tables import read_table

# Fixed values of the adapter: rating by last digit of the document id; four
# reviews a product, and every 13th review of a product that is not listed.
RATING_BY_LAST_DIGIT = [5.0, 5.0, 5.0, 5.0, 4.0, 4.0, 3.0, 2.0, 1.0, 1.0]
REVIEWS_PER_PRODUCT, UNLISTED = 4, 13
MODELS = ["m_a", "m_b", "m_c"]


def reviews(spark: SparkSession, sf_dir: str, text_key: bool = False) -> DataFrame:
    """``text_key`` adds the text's SHA-256, made before the join, so that who
    reads only the digest moves no text."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    if text_key:
        docs = docs.withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256))
    events = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    joined = docs.join(events, docs.doc_id == events.event_id, "left")
    digit = (F.col("doc_id") % 10).cast("int")
    rating = F.element_at(F.array(*[F.lit(x) for x in RATING_BY_LAST_DIGIT]), digit + 1)
    return joined.select(
        F.col("doc_id").alias("review_id"),
        T.title_of("text").alias("title"),
        F.col("text"),
        rating.alias("rating"),
        F.concat(F.when(F.col("doc_id") % UNLISTED == 0, F.lit("x")).otherwise(F.lit("")),
                 F.expr(f"doc_id DIV {REVIEWS_PER_PRODUCT}").cast("string")).alias("parent_asin"),
        (F.col("doc_id") % 11 != 0).alias("verified_purchase"),
        (F.col("doc_id") % 7).alias("helpful_vote"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("ts").cast("timestamp").alias("ts"),
        *(["text_key"] if text_key else []),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    return part.select(
        F.col("p_partkey").cast("string").alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("main_category"),
        F.when(F.col("p_partkey") % 17 == 0, F.lit("n/a"))
         .when(F.col("p_partkey") % 19 == 0, F.concat(F.lit("from $"), F.col("p_retailprice").cast("string")))
         .otherwise(F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))).alias("price"),
        F.concat(F.lit('["Office Products", "'), F.col("p_type"), F.lit('"]')).alias("categories"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    factor = (F.col("vec_id") % 3 + 1).cast("double")
    return emb.select(
        F.col("vec_id").alias("review_id"),
        F.transform("embedding", lambda x: x.cast("double") * factor).alias("embedding"),
        F.col("label"),
    )


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (model, review_id, label, proba array<double>)."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    parts = [
        F.struct(F.lit(m).alias("model"),
                 V.softmax(F.slice("embedding", 1 + 3 * i, 3)).alias("proba"))
        for i, m in enumerate(MODELS)
    ]
    return emb.select(
        F.col("vec_id").alias("review_id"),
        (F.col("label") % 3).cast("int").alias("label"),
        F.explode(F.array(*parts)).alias("p"),
    ).select("p.model", "review_id", "label", "p.proba")
