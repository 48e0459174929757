"""The queries of this package: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.bbit_minhash import SQL as near_duplicates_sql
from textlake.llm.code_bounds import SQL as code_bounds_sql
from textlake.llm.common import held_out, read_table, stage
from textlake.llm.line_chunks import SQL as line_chunks_sql
from textlake.llm.prefix_trie import SQL as prefix_trie_sql
from textlake.llm.temperature_mix import SQL as temperature_mix_sql
from textlake.llm.winnow import SQL as winnow_sql

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


@query("op9_near_duplicates", near_duplicates_sql)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlake.llm.bbit_minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op1_quality_votes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlake.llm.quality_knn import learn, score_quality

    docs = read_table(spark, sf_dir, "documents")
    scored = score_quality(docs, learn(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", "predicted")


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlake.llm.secret_scan import scan_secrets, span_text

    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = span_text(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


@query("op3_language_zstd")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlake.llm.langid_zstd import train_and_identify

    out = train_and_identify(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op5_winnowing", winnow_sql)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlake.llm.winnow import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("item_ids")


@query("op6_token_frames")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from textlake.llm.token_frames import tokens_round_trip

    return tokens_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_recurrent_lm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlake.llm.language_model import score_documents

    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 1))
    return score_documents(docs, docs.where("NOT held_out"), keep=("held_out",))


@query("op7_kmeans_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlake.llm.kmeans_tree import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


@query("op4_line_chunks", line_chunks_sql)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlake.llm.line_chunks import remove_repeated_chunks

    return remove_repeated_chunks(read_table(spark, sf_dir, "documents"))


@query("op10_temperature_mix", temperature_mix_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlake.llm.temperature_mix import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents"))


@query("op12_bpe_transducer")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from textlake.llm.bpe_transducer import broadcast_rules, broadcast_tokens, read_ranks, round_trip

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = read_ranks(lines)
    rules, tokens = broadcast_rules(spark, ranks, public_tokenizers.PATTERN), broadcast_tokens(spark, ranks)
    return round_trip(read_table(spark, sf_dir, "documents"), rules, tokens).select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op11_code_bounds", code_bounds_sql)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    from textlake.llm.code_bounds import compress

    codes, books = compress(read_table(spark, sf_dir, "embeddings"), keep=("label",))
    codes = stage(codes, "vector-codes")
    # a label's errors may pass the largest long, the table's do not
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), F.least("label_error", F.lit((1 << 63) - 1)).cast("long").alias("label_error"))
    numbers = ",".join(str(x) for part in books for entry in part for x in entry)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.array_join(F.transform("code", lambda c: F.format_string("%02x", c)), "").alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


@query("op13_prefix_trie", prefix_trie_sql)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlake.llm.prefix_trie import prefix_trie

    return prefix_trie(read_table(spark, sf_dir, "conversations"))
