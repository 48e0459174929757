"""Structured Streaming jobs.

Each job reads a folder of Parquet files with an explicit schema, uses event
time with a watermark (``ts`` must be TIMESTAMP, not TIMESTAMP_NTZ), and only
ever appends to its sink:

* cleaning, dedupe and windowed counts (tumbling, sliding, session) use the
  file sink in ``append`` mode. A window is written once, when the watermark
  has passed its end, and its state is dropped then;
* the quota sampler, the incremental indexes and the late-row report are
  ``foreachBatch`` jobs of batch operators; the indexes see each id once, by
  the stream's state. A batch writes the folder
  ``batch=<id>`` and nothing else, so a replayed batch replaces its own rows;
  what earlier batches wrote is read, never rewritten.

``trigger(availableNow=True)`` processes what has landed and stops; running a
job again with the same base folder goes on from its checkpoint. All folders
live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textlake.functions import labels as L
from textlake.operators import clean as C
from textlake.operators import features as FE
from textlake.operators import sampling as S
from textlake.session import checkpoint_root

# Fixed values of the drift rules: limits and status words.
POSITIVE_LIMIT, CONFIDENCE_FLOOR = 40.0, 0.75
STABLE, ALERT = "estable", "alerta"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def workdir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/textlake-stream/{name}-{uuid.uuid4().hex[:12]}"


def land(df: DataFrame, path: str) -> str:
    """Add the rows to a landing folder as new files."""
    df.write.mode("append").parquet(path)
    return path


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def run_to_completion(q: StreamingQuery) -> StreamingQuery:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def append_to_files(out: DataFrame, base: str) -> DataFrame:
    """Run a stream into the file sink (each row once, also after a restart) and read the sink."""
    run_into_files(out, base)
    return out.sparkSession.read.schema(out.schema).parquet(f"{base}/out")


def run_into_files(out: DataFrame, base: str) -> StreamingQuery:
    return run_to_completion(out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
                             .option("checkpointLocation", f"{base}/_ckpt").trigger(availableNow=True).start())


def observed(q: StreamingQuery, spark: SparkSession) -> list[dict]:
    """The metrics observed in every batch of a finished run, {name: Row} each."""
    most = int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates"))
    progress = q.recentProgress
    if len(progress) >= most:
        raise ValueError(f"only the last {most} batches are known; raise spark.sql.streaming.numRecentProgressUpdates")
    return [p.observedMetrics for p in progress if p.observedMetrics]


def append_batches(stream: DataFrame, base: str, schema: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Run ``build(batch, earlier rows)`` on every batch and append its rows;
    returns all rows, with the column ``batch``."""
    spark, table = stream.sparkSession, f"{base}/table"
    with_batch = f"{schema}, batch long"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{table}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        earlier = s.read.schema(with_batch).parquet(table).where(F.col("batch") < batch_id)
        build(batch, earlier).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    run_to_completion(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/_ckpt")
                      .trigger(availableNow=True).start())
    return spark.read.schema(with_batch).parquet(table)


# ---------------------------------------------------------------- Z1 ------
def clean_stream(reviews: DataFrame) -> DataFrame:
    """The row-local part of the cleaning (P2-P5) plus the features, which
    needs no state and runs unchanged on a stream."""
    r = C.drop_nulls(reviews, ["text", "rating"])
    r = C.verified_only(r)
    r = C.min_chars(r)
    r = C.min_words_space(r)
    return FE.text_features(r.select("review_id", "text", "rating", "parent_asin", "ts"))


def stream_ingest(spark: SparkSession, reviews: DataFrame, base: str | None = None) -> DataFrame:
    base = base or workdir(spark, "ingest")
    stream = read_stream(spark, land(reviews, f"{base}/input"), reviews.schema)
    return append_to_files(clean_stream(stream).drop("text"), base)


def stream_ingest_counts(spark: SparkSession, reviews: DataFrame, base: str | None = None) -> DataFrame:
    """Rows read and kept by one run of the ingest, counted while it runs: (batch, rows_read, rows_kept)."""
    base = base or workdir(spark, "ingest-counts")
    stream = read_stream(spark, land(reviews, f"{base}/input"), reviews.schema)
    kept = clean_stream(stream.observe("read", F.count(F.lit(1)).alias("n"))).drop("text").observe("kept", F.count(F.lit(1)).alias("n"))
    rows = [(i, m["read"]["n"], m["kept"]["n"]) for i, m in enumerate(observed(run_into_files(kept, base), spark))]
    return spark.createDataFrame(rows, "batch long, rows_read long, rows_kept long")


# ---------------------------------------------------------------- Z2 ------
def stream_dedupe(spark: SparkSession, reviews: DataFrame, delay: str = "7 days", base: str | None = None) -> DataFrame:
    """One row per text hash; a hash is forgotten once the watermark is
    ``delay`` past its first row, so the state covers that span only."""
    base = base or workdir(spark, "dedupe")
    rows = reviews.select("review_id", "text", "ts")
    stream = read_stream(spark, land(rows, f"{base}/input"), rows.schema)
    d = (stream.withColumn("text_md5", F.md5("text")).withWatermark("ts", delay)
         .dropDuplicatesWithinWatermark(["text_md5"]).select("text_md5"))
    return append_to_files(d, base)


# ---------------------------------------------------------------- Z3 ------
def windowed_counts(events: DataFrame, kind: str, duration: str, slide: str | None = None,
                    key: str = "event_type", delay: str = "1 day") -> DataFrame:
    """Z3 on a streaming or batch DataFrame with a TIMESTAMP ``ts``."""
    ev = events.withWatermark("ts", delay) if events.isStreaming else events
    if kind == "session":
        w = F.session_window("ts", duration)
    elif kind == "sliding":
        w = F.window("ts", duration, slide)
    else:
        w = F.window("ts", duration)
    agg = ev.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("v"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), key, "n", "v")


def stream_windowed(spark: SparkSession, events: DataFrame, kind: str, duration: str, slide: str | None = None,
                    key: str = "event_type", delay: str = "1 day", base: str | None = None) -> DataFrame:
    """The windows that the watermark (largest ``ts`` so far less ``delay``) has passed."""
    base = base or workdir(spark, f"win-{kind}")
    stream = read_stream(spark, land(events, f"{base}/input"), events.schema)
    return append_to_files(windowed_counts(stream, kind, duration, slide, key, delay), base)


# ---------------------------------------------------------------- Z4/Z5 ---
def class_counts(reviews: DataFrame, duration: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Rows per window and class, on a stream or a table."""
    r = reviews.withWatermark("ts", delay) if reviews.isStreaming else reviews
    per = r.groupBy(F.window("ts", duration).alias("w"), L.target_class("rating").alias("target_class")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "target_class", "n")


def positive_share_drift(per: DataFrame, threshold: float = POSITIVE_LIMIT) -> DataFrame:
    """Share of positive reviews per window of ``class_counts``; fixed rule
    (> threshold is stable) plus a population-stability index against all windows."""
    base = per.groupBy("target_class").agg(F.sum("n").alias("nb"))
    base = base.withColumn("pb", F.col("nb") / per.agg(F.sum("n").alias("all")).scalar())
    size = per.groupBy("window_start").agg(F.sum("n").alias("size"))
    j = per.join(base, "target_class").join(size, "window_start").withColumn("p", F.col("n") / F.col("size"))
    eps = 1e-6
    psi_term = (F.col("p") - F.col("pb")) * F.log((F.col("p") + eps) / (F.col("pb") + eps))
    out = j.groupBy("window_start").agg(
        F.sum(F.when(F.col("target_class") == "Positivo", F.col("p")).otherwise(0.0)).alias("pos"),
        F.sum(psi_term).alias("psi"), F.sum("n").alias("n"))
    pos = F.round(F.col("pos") * 100, 6)
    return out.select("window_start", "n", pos.alias("positive_pct"),
                      F.when(pos > threshold, F.lit(STABLE)).otherwise(F.lit(ALERT)).alias("status"),
                      F.round("psi", 6).alias("psi"))


def mean_confidence(scored: DataFrame, duration: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Mean confidence and rows per window, on a stream or a table."""
    s = scored.withWatermark("ts", delay) if scored.isStreaming else scored
    per = s.groupBy(F.window("ts", duration).alias("w")).agg(F.avg("confidence").alias("c"), F.count(F.lit(1)).alias("n"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), "c", "n")


def confidence_drift(per: DataFrame, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Mean confidence per window, its change against the window that ends
    where it starts, and a floor rule."""
    before = per.select(F.col("window_end").alias("window_start"), F.col("c").alias("_before"))
    j = per.join(before, "window_start", "left")
    return j.select("window_start", "n", F.round("c", 6).alias("mean_confidence"),
                    F.round(F.col("c") - F.col("_before"), 6).alias("delta"), (F.col("c") >= floor).alias("above_floor"))


def stream_positive_share(spark: SparkSession, reviews: DataFrame, base: str | None = None) -> DataFrame:
    """Z4 on a stream: closed windows are appended as they close, and the rule is applied to them."""
    base = base or workdir(spark, "share")
    rows = reviews.select("ts", "rating")
    stream = read_stream(spark, land(rows, f"{base}/input"), rows.schema)
    return positive_share_drift(append_to_files(class_counts(stream), base))


def stream_confidence(spark: SparkSession, scored: DataFrame, base: str | None = None) -> DataFrame:
    """Z5 on a stream, as ``stream_positive_share``."""
    base = base or workdir(spark, "confidence")
    rows = scored.select("ts", "confidence")
    stream = read_stream(spark, land(rows, f"{base}/input"), rows.schema)
    return confidence_drift(append_to_files(mean_confidence(stream), base))


# ---------------------------------------------------------------- Z6 ------
@contextlib.contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started here keep their state in RocksDB: what exceeds memory is on the executors' disks, changes go to the checkpoint."""
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_PROVIDER, before)


def append_unseen(stream: DataFrame, base: str, id_col: str, schema: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append ``build`` of the rows whose id no earlier batch had. The ids are
    the stream's own state (one entry an id, split over the partitions, restored
    after a restart); the index itself is never read. A null id is an id."""
    with state_on_disk(stream.sparkSession):
        return append_batches(stream.dropDuplicates([id_col]), base, schema, lambda batch, _earlier: build(batch))


def stream_incremental_index(spark: SparkSession, vectors: DataFrame, base: str | None = None) -> DataFrame:
    """Normalized vectors; the rows land twice, the index holds each id once."""
    from textlake.operators.search import build_vector_index
    base = base or workdir(spark, "index")
    schema = "review_id long, vec array<double>, label int"
    for _ in range(2):
        land(vectors, f"{base}/input")
        index = append_unseen(read_stream(spark, f"{base}/input", vectors.schema), base, "review_id", schema,
                              lambda d: build_vector_index(d, keep=["label"]))
    return index


def stream_incremental_postings(spark: SparkSession, reviews: DataFrame, base: str | None = None) -> DataFrame:
    """Postings (review_id, term, tf) of the lexical index, kept the same way. A
    batch has each id once, so its rows are counted one by one."""
    from textlake.operators import text as TX
    base = base or workdir(spark, "postings")
    rows = reviews.select("review_id", "text")
    for _ in range(2):
        land(rows, f"{base}/input")
        index = append_unseen(read_stream(spark, f"{base}/input", rows.schema), base, "review_id", "review_id long, term string, tf long",
                              lambda d: TX.counted(TX.with_terms(d, "text", (1, 1), TX.english_stop_words()), ["review_id"], "_terms"))
    return index


# ---------------------------------------------------------------- Z7 ------
def stream_quota(spark: SparkSession, reviews: DataFrame, q: int, base: str | None = None) -> DataFrame:
    """Keep the first ``q`` rows per quota class in arrival order (batch,
    then id), drop the rest. Each batch reads the counts of the rows kept so
    far and appends what is left of the quotas."""
    base = base or workdir(spark, "quota")
    rows = reviews.select("review_id", "rating")
    stream = read_stream(spark, land(rows, f"{base}/input"), rows.schema)

    def take(batch: DataFrame, earlier: DataFrame) -> DataFrame:
        b = batch.select("review_id", L.quota_class("rating").alias("quota_class")).where(F.col("quota_class").isNotNull())
        used = earlier.groupBy("quota_class").agg(F.count(F.lit(1)).alias("_used"))
        b = b.join(used, "quota_class", "left")
        b = b.withColumn("_left", F.greatest(F.lit(q) - F.coalesce("_used", F.lit(0)), F.lit(0))).drop("_used")
        return S.quota_head(b, "quota_class", "review_id", "_left").select("review_id", "quota_class")

    return append_batches(stream, base, "review_id long, quota_class string", take).drop("batch")


# ---------------------------------------------------------------- Z8 ------
def stream_late_data(spark: SparkSession, parts: list[DataFrame], duration: str = "1 hour", delay: str = "1 hour",
                     base: str | None = None) -> DataFrame:
    """Per batch, the rows read and those whose window the watermark had
    already passed, which a windowed count drops. The watermark of a batch is
    the largest ``ts`` of the batches before it, less ``delay``; it is kept in
    the report itself, so the count is one of rows and survives restarts.
    ``parts`` land one after the other, each followed by a run."""
    base = base or workdir(spark, "late")

    def count(batch: DataFrame, earlier: DataFrame) -> DataFrame:
        mark = earlier.agg(F.max("max_ts").alias("m")).scalar() - F.expr(f"INTERVAL {delay}")
        late = F.window("ts", duration).end <= mark
        one = batch.select("ts", F.coalesce(late, F.lit(False)).alias("late")) if earlier.where("max_ts IS NOT NULL").take(1) \
            else batch.select("ts", F.lit(False).alias("late"))
        return one.agg(F.count(F.lit(1)).alias("input_rows"), F.count_if("late").alias("dropped_rows"), F.max("ts").alias("max_ts"))

    report = None
    for part in parts:
        land(part, f"{base}/input")
        report = append_batches(read_stream(spark, f"{base}/input", part.schema), base,
                                "input_rows long, dropped_rows long, max_ts timestamp", count)
    return report.select(F.col("batch").alias("batch_id"), "input_rows", "dropped_rows")
