"""Sources and sinks.

Readers always get an explicit schema (no per-file inference). Writers are
idempotent: ``mode("ignore")`` skips a job whose output already exists, the
Parquet committer makes each write all-or-nothing, and numbered part files
are capped with ``maxRecordsPerFile``.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.session import checkpoint_root, configure

CORRUPT = "_corrupt_record"
COUNTS = "rows long, rejected long, kept long"

REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("images", T.StringType()),
    T.StructField("asin", T.StringType()),
    T.StructField("parent_asin", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("verified_purchase", T.BooleanType()),
    T.StructField("helpful_vote", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField(CORRUPT, T.StringType()),
])

PRODUCT_FIELDS = ["parent_asin", "title", "main_category", "price", "categories", "details"]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/textlake-io/{name}-{uuid.uuid4().hex[:12]}"


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> str:
    w = df.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.json(path)
    return path


def ingest_reviews(spark: SparkSession, src: str, out: str, batch_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """JSON lines (plain or gzip) -> Parquet parts of ``batch_rows`` rows at most.

    One pass parses, writes and counts every line, good and malformed ones in a
    partition of their own. The counts (``ingest_counts``) are written last, and
    the job is skipped where they exist, so an interrupted job is repeated. Nested
    fields and prices stay text. A gzip file is read by one task and written in
    parts, so what follows runs in parallel. Returns (good rows, rejected lines) as
    read back."""
    if ingest_counts(spark, out) is None:
        # A session that has observed a query can no longer be serialized, which some
        # MLlib models need; so this is done in a session of its own.
        side = configure(spark.newSession())
        raw = (side.read.schema(REVIEW_SCHEMA).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", CORRUPT).json(src))
        raw = raw.withColumn("rejected", F.col(CORRUPT).isNotNull())
        seen = Observation()
        counted = raw.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("rejected").alias("rejected"))
        counted.write.mode("overwrite").option("maxRecordsPerFile", batch_rows).partitionBy("rejected").parquet(out)
        rows, rejected = seen.get["rows"], seen.get["rejected"]
        spark.createDataFrame([(rows, rejected, rows - rejected)], COUNTS).coalesce(1).write.mode("overwrite").json(f"{out.rstrip('/')}_counts")
    written = spark.read.schema(T.StructType([*REVIEW_SCHEMA.fields, T.StructField("rejected", T.BooleanType())])).parquet(out)
    return written.where("NOT rejected").drop(CORRUPT, "rejected"), written.where("rejected").select(CORRUPT)


def ingest_counts(spark: SparkSession, out: str) -> DataFrame | None:
    """(rows, rejected, kept) as observed while the lines were written to ``out``; None before that."""
    try:
        counts = spark.read.schema(COUNTS).json(f"{out.rstrip('/')}_counts")
        return counts if counts.take(1) else None
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def ingest_products(spark: SparkSession, src: str, out: str, batch_rows: int = 50_000) -> DataFrame:
    """Every field read as string; nested values arrive as raw JSON text."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in PRODUCT_FIELDS])
    df = spark.read.schema(schema).json(src)
    df.write.mode("ignore").option("maxRecordsPerFile", batch_rows).parquet(out)
    return spark.read.parquet(out)


def write_csv(df: DataFrame, path: str, gzip: bool = True) -> str:
    """S6"""
    w = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Header, quoted multi-line fields, explicit schema; ``columns`` = usecols."""
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("escape", '"').csv(path))
    return df.select(*columns) if columns else df


def write_canonical(df: DataFrame, path: str) -> DataFrame:
    """Export once; an existing export is kept."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report_json(doc: DataFrame, path: str) -> DataFrame:
    """A one-row nested document -> one JSON text file."""
    doc.select(F.to_json(F.struct(*doc.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return doc.sparkSession.read.text(path)


def save_split_artifacts(df: DataFrame, path: str) -> str:
    """One table partitioned by split (ids carried, nothing positional)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def load_embedding_splits(spark: SparkSession, path: str, splits=("train", "val", "test")) -> DataFrame:
    """Read every split; a missing split is an error, as in the reference."""
    try:
        parts = [spark.read.parquet(f"{path}/split={s}").withColumn("split", F.lit(s)) for s in splits]
    except AnalysisException as e:
        raise FileNotFoundError(f"a split of {splits} is missing under {path}") from e
    return functools.reduce(DataFrame.unionByName, parts)


def save_predictions(df: DataFrame, path: str) -> str:
    """(model, split, review_id, label, pred, proba) partitioned by model."""
    df.write.mode("overwrite").partitionBy("model").parquet(path)
    return path


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_CLASS_SCORES = T.MapType(T.StringType(), T.StructType([
    T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()), T.StructField("support", T.LongType())]))
# The fields of a metric document, the two names of its training
# time, and the field under which one kind of report nests its scores.
TIME_FIELDS = ("training_time_seconds", "training_time_sec")
NESTED = "improved_results"
_SCORES = [*(T.StructField(c, T.DoubleType()) for c in ("f1_macro", "precision_macro", "recall_macro", "accuracy")),
           T.StructField("per_class", _CLASS_SCORES), T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType())))]
_HEAD = [T.StructField("model_name", T.StringType()), T.StructField("model_type", T.StringType())]
_TIMES = [T.StructField(c, T.DoubleType()) for c in TIME_FIELDS]
METRIC_SCHEMA = T.StructType([*_HEAD, T.StructField("training_time_seconds", T.DoubleType()), *_SCORES])
_DOCUMENT = T.StructType([*_HEAD, *_TIMES, *_SCORES, T.StructField(NESTED, T.StructType([*_HEAD, *_TIMES, *_SCORES]))])


def _present(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that can be read; the others are named in a message."""
    found = []
    for p in paths:
        try:
            spark.read.text(p)
            found.append(p)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            print(f"[textlake] metric report not found, skipped: {p}")
    return found


def load_metric_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Metric documents in file order: (file, pos, source, METRIC_SCHEMA fields).

    A file holds an object, an array of objects, or an object whose scores are
    under NESTED; fields given outside it are kept where it has none. Either
    name of the training time is read. Missing files, text that is no JSON and
    objects without a model name or a score are skipped, the files that give
    no document with a message."""
    found = _present(spark, paths)
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.IntegerType()), T.StructField("pos", T.IntegerType()),
                                                       T.StructField("source", T.StringType()), *METRIC_SCHEMA.fields]))
    parts = [spark.read.text(p, wholetext=True).select(F.lit(i).alias("file"), F.lit(p).alias("source"), F.trim("value").alias("v")) for i, p in enumerate(found)]
    raw = functools.reduce(DataFrame.unionByName, parts)
    docs = F.when(F.col("v").startswith("["), F.from_json("v", T.ArrayType(_DOCUMENT))).otherwise(F.array(F.from_json("v", _DOCUMENT)))
    docs = raw.select("file", "source", F.posexplode(docs).alias("pos", "d"))
    inner = F.col(f"d.{NESTED}")
    field = lambda c: F.coalesce(inner[c], F.col(f"d.{c}"))
    time = F.coalesce(*[field(c) for c in TIME_FIELDS]).alias("training_time_seconds")
    cols = [time if f.name == "training_time_seconds" else field(f.name).alias(f.name) for f in METRIC_SCHEMA]
    out = docs.select("file", "pos", "source", *cols).where("model_name IS NOT NULL AND (f1_macro IS NOT NULL OR accuracy IS NOT NULL)")
    read = {r["file"] for r in out.select("file").distinct().collect()}  # one row per file
    for i, p in enumerate(found):
        if i not in read:
            print(f"[textlake] no metric document in {p}, skipped")
    return out


def track_runs(runs: DataFrame, path: str) -> DataFrame:
    """Append run records (experiment, run_name, params, metrics, tags) to
    the runs table in one write; every record gets an id and the time."""
    runs.withColumn("run_id", F.expr("uuid()")).withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)
    return runs.sparkSession.read.parquet(path)
