"""Queries: monitoring and Structured Streaming jobs.

Streaming queries land Spark-derived input files in the session's checkpoint
folder, run the stream to completion (``availableNow``) and return the sink
table. Where the stream result equals a batch result (no late rows), the
oracle is the batch SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.plans.registry import register
from textlake.plans.q_text import _TOKS as TOKENS_SQL
from textlake.plans.sqlviews import with_ctes
from textlake.sources import views as V
from textlake.sources.tables import read_table
from textlake.streaming import jobs as Z


def _events(spark, sf):
    return read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"]) \
        .withColumn("ts", F.col("ts").cast("timestamp"))


_FEAT_SQL = """
    SELECT review_id, rating, CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS mayusculas_count,
           CAST(length(text) AS BIGINT) AS char_total,
           CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS total_tokens,
           CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS unique_types
    FROM reviews
    WHERE text IS NOT NULL AND rating IS NOT NULL AND verified_purchase AND length(text) > 20
      AND len(string_split(text, ' ')) >= 5"""


@register("stream_ingest", "stream", with_ctes(_FEAT_SQL, "reviews"))
def stream_ingest(spark, sf):
    out = Z.stream_ingest(spark, V.reviews(spark, sf))
    return out.select("review_id", "rating", "mayusculas_count", "char_total", "total_tokens", "unique_types")


@register("stream_ingest_counts", "stream", with_ctes(
    f"SELECT (SELECT count(*) FROM reviews) AS rows_read, (SELECT count(*) FROM ({_FEAT_SQL})) AS rows_kept", "reviews"))
def stream_ingest_counts(spark, sf):
    """What the ingest read and kept, observed in its own pass."""
    return Z.stream_ingest_counts(spark, V.reviews(spark, sf)).agg(F.sum("rows_read").alias("rows_read"), F.sum("rows_kept").alias("rows_kept"))


@register("stream_dedupe", "stream", with_ctes("SELECT DISTINCT md5(text) AS text_md5 FROM reviews", "reviews"))
def stream_dedupe(spark, sf):
    return Z.stream_dedupe(spark, V.reviews(spark, sf))


@register("stream_tumbling", "stream", """
    SELECT ws AS window_start, ws + INTERVAL 1 day AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS v
    FROM (SELECT *, time_bucket(INTERVAL 1 day, ts) AS ws FROM events)
    GROUP BY ALL HAVING ws + INTERVAL 1 day <= (SELECT max(ts) FROM events) - INTERVAL 1 day""")
def stream_tumbling(spark, sf):
    return Z.stream_windowed(spark, _events(spark, sf), "tumbling", "1 day")


@register("stream_sliding", "stream", """
    SELECT ws AS window_start, ws + INTERVAL 1 day AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS v
    FROM (SELECT time_bucket(INTERVAL 6 hour, ts) - k * INTERVAL 6 hour AS ws, event_type, value
          FROM events, range(0, 4) r(k))
    GROUP BY ALL HAVING ws + INTERVAL 1 day <= (SELECT max(ts) FROM events) - INTERVAL 1 day""")
def stream_sliding(spark, sf):
    return Z.stream_windowed(spark, _events(spark, sf), "sliding", "1 day", "6 hours")


@register("stream_session", "stream", """
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 minute AS window_end, user_id,
           count(*) AS n, round(sum(value), 6) AS v
    FROM (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
          FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                                 OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 minute
                               THEN 1 ELSE 0 END AS new_s FROM events))
    GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 minute <= (SELECT max(ts) FROM events) - INTERVAL 1 day""")
def stream_session(spark, sf):
    return Z.stream_windowed(spark, _events(spark, sf), "session", "30 minutes", key="user_id")


@register("drift_positive_share", "stream", with_ctes("""
    SELECT ws AS window_start, sum(n) AS n,
           round(sum(CASE WHEN target_class = 'Positivo' THEN p ELSE 0 END) * 100, 6) AS positive_pct,
           CASE WHEN round(sum(CASE WHEN target_class = 'Positivo' THEN p ELSE 0 END) * 100, 6) > 40
                THEN 'estable' ELSE 'alerta' END AS status,
           round(sum((p - pb) * ln((p + 1e-6) / (pb + 1e-6))), 6) AS psi
    FROM (SELECT *, n / sum(n) OVER (PARTITION BY ws) AS p FROM per) pp JOIN base USING (target_class)
    GROUP BY ws""", "reviews", extra=[
    ("rv", "SELECT ts, CASE WHEN rating IN (1, 2) THEN 'Negativo' WHEN rating = 3 THEN 'Neutro' ELSE 'Positivo' END "
           "AS target_class FROM reviews"),
    ("per", "SELECT ws, target_class, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 6 hour, ts) AS ws FROM rv) "
            "GROUP BY ws, target_class HAVING ws + INTERVAL 6 hour <= (SELECT max(ts) FROM rv) - INTERVAL 1 hour"),
    ("base", "SELECT target_class, nb / sum(nb) OVER () AS pb FROM (SELECT target_class, sum(n) AS nb FROM per GROUP BY 1)")]))
def drift_positive_share(spark, sf):
    return Z.stream_positive_share(spark, V.reviews(spark, sf))


@register("drift_confidence", "stream", with_ctes("""
    SELECT w.window_start, w.n, round(w.c, 6) AS mean_confidence, round(w.c - b.c, 6) AS delta, w.c >= 0.75 AS above_floor
    FROM win w LEFT JOIN win b ON b.window_start + INTERVAL 6 hour = w.window_start""", "probs", extra=[
    ("sc", "SELECT e.ts, time_bucket(INTERVAL 6 hour, e.ts) AS window_start, list_max(p.proba) AS c "
           "FROM probs p JOIN events e ON e.event_id = p.review_id"),
    ("win", "SELECT window_start, avg(c) AS c, count(*) AS n FROM sc GROUP BY 1 "
            "HAVING window_start + INTERVAL 6 hour <= (SELECT max(ts) FROM sc) - INTERVAL 1 hour")]))
def drift_confidence(spark, sf):
    p = V.probs(spark, sf)
    ev = _events(spark, sf).select(F.col("event_id").alias("review_id"), "ts")
    scored = p.join(ev, "review_id", "inner").withColumn("confidence", F.array_max("proba"))
    return Z.stream_confidence(spark, scored)


@register("stream_incremental_index", "stream", with_ctes(
    "SELECT review_id, label, list_transform(embedding, lambda x: round(x, 6)) AS vec FROM unit_vectors",
    "unit_vectors"))
def stream_incremental_index(spark, sf):
    idx = Z.stream_incremental_index(spark, V.vectors(spark, sf))
    return idx.select("review_id", "label", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


_QC = ("CASE WHEN coalesce(rating, 0) <= 2 THEN 'negativo' WHEN rating = 3 THEN 'neutro' "
       "WHEN rating >= 4 THEN 'positivo' END")


@register("stream_quota", "stream", with_ctes(f"""
    SELECT review_id, quota_class FROM (
      SELECT review_id, {_QC} AS quota_class, row_number() OVER (PARTITION BY {_QC} ORDER BY review_id) AS rn
      FROM reviews) WHERE rn <= 100 AND quota_class IS NOT NULL""", "reviews"))
def stream_quota(spark, sf):
    return Z.stream_quota(spark, V.reviews(spark, sf), 100)


@register("stream_incremental_postings", "stream", with_ctes(
    "SELECT review_id, term, count(*) AS tf FROM (SELECT review_id, unnest(" + TOKENS_SQL.format(t="text") +
    ") AS term FROM reviews) GROUP BY ALL", "reviews"))
def stream_incremental_postings(spark, sf):
    return Z.stream_incremental_postings(spark, V.reviews(spark, sf)).select("review_id", "term", "tf")


@register("stream_late_data", "stream", """
    WITH cut AS (SELECT *, ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS second FROM events)
    SELECT 0::BIGINT AS batch_id, count(*) AS input_rows, 0::BIGINT AS dropped_rows FROM cut WHERE NOT second
    UNION ALL
    SELECT 1, count(*), count(*) FILTER (time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 1 hour)
    FROM cut WHERE second""")
def stream_late_data(spark, sf):
    """The later half of the period lands first, so most of the earlier half is late."""
    ev = _events(spark, sf)
    ends = ev.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    cut = ends["lo"] + (ends["hi"] - ends["lo"]) / 2
    return Z.stream_late_data(spark, [ev.where(F.col("ts") >= cut), ev.where(F.col("ts") < cut)])


