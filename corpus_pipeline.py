"""Corpus pipeline: documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame, which ``run`` writes as Parquet in the shared folder and
reads again for the next stage. All but the last return the columns of
``docs``. Rows are told apart by a hash of id and text, so null and repeated
ids need no care from the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.bbit_minhash import near_duplicates
from textlake.llm.common import read_table, stage
from textlake.llm.quality_knn import learn, score_quality
from textlake.llm.temperature_mix import mix_sources
from textlake.llm.token_frames import tokens_round_trip
from textlake.llm.winnow import contamination

KEY, ID, TEXT, SOURCE = "row_key", "in_doc_id", "in_text", "in_source"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row key of 128 bits, its own columns under a prefix, so that no name can clash."""
    own = docs.toDF(*(f"in_{c}" for c in docs.columns))
    parts = [F.coalesce(F.col(ID).cast("string"), F.lit("-")), F.when(F.col(TEXT).isNull(), F.lit("|")).otherwise(F.lit("||")), F.coalesce(F.col(TEXT), F.lit(""))]
    return own.withColumn(KEY, F.md5(F.concat(*parts).cast("binary")))


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(f"in_{c}" for c in docs.columns)).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote accepts (score 0.3 or more)."""
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    rows = _keyed(docs).drop(KEY)
    return _restored(score_quality(rows, model, text_col=TEXT, keep=tuple(rows.columns)).where("predicted = 1"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: of the smallest id, and of
    several texts of that id the one of the smallest row key. Identical rows are
    one document; rows without an id are compared with those only."""
    found = near_duplicates(_keyed(docs), ID, TEXT, key_col=KEY).where("component IS NOT NULL")
    found = stage(found.select("component", F.struct(F.col(ID).alias("id"), "row_key").alias("row")), "copies")
    first = found.groupBy("component").agg(F.min("row").alias("first"))
    gone = found.select("row.row_key").distinct().join(first.select("first.row_key").hint("merge"), "row_key", "left_anti")
    rows = _keyed(docs).join(stage(gone, "gone"), KEY, "left_anti")
    again = stage(rows.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").select(KEY), "repeated-rows")
    return _restored(rows.join(again, KEY, "left_anti").unionByName(rows.join(again, KEY, "left_semi").dropDuplicates([KEY])), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    rows = _keyed(docs)
    hit = contamination(rows, read_table(spark, sf_dir, "benchmark"), id_col=KEY, text_col=TEXT).where("contaminated").select(KEY).distinct()
    return _restored(rows.join(stage(hit, "contaminated"), KEY, "left_anti"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, repeated as often as its source's weight asks for."""
    rows = _keyed(docs)
    uses = mix_sources(rows, id_col=KEY, source_col=SOURCE, text_col=TEXT).groupBy(KEY).agg(F.count("*").alias("n"), F.count_if(F.col("epoch") == 0).alias("rows"))
    uses = stage(uses.select(KEY, F.round(F.col("n") / F.col("rows")).cast("int").alias("uses")), "uses")
    return _restored(rows.join(uses, KEY).withColumn("use", F.explode(F.sequence(F.lit(1), "uses"))), docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; (doc_id, start, n_tokens, ids_crc32) as read back from them."""
    import public_tokenizers

    return tokens_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_copies),
    ("benchmark decontamination", decontaminate),
    ("temperature mixing", mix),
    ("token files", token_files),
]

#: The first stage's model has no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
