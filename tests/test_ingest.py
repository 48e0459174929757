"""Counts observed while lines are ingested, and jobs that are skipped or repeated."""

import datetime as dt

from textlake.sources import io as IO
from textlake.streaming import jobs as Z


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    lines = ['{"review_id": 1, "text": "a", "rating": 5.0}', "{broken", '{"review_id": 2}', "no json", '{"review_id": 3, "images": [{"u": 1}]}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/raw")
    out = f"{tmp_path}/out"
    assert IO.ingest_counts(spark, out) is None
    good, bad = IO.ingest_reviews(spark, f"{tmp_path}/raw", out)
    assert (good.count(), bad.count()) == (3, 2) and tuple(IO.ingest_counts(spark, out).first()) == (5, 2, 3)
    assert good.where("images LIKE '%u%1%'").count() == 1
    spark.createDataFrame([('{"review_id": 9}',)], "value string").write.mode("append").text(f"{tmp_path}/raw")
    assert IO.ingest_reviews(spark, f"{tmp_path}/raw", out)[0].count() == 3  # already done
    spark.createDataFrame([], IO.COUNTS).write.mode("overwrite").json(f"{out}_counts")  # as after an interrupted job
    assert IO.ingest_reviews(spark, f"{tmp_path}/raw", out)[0].count() == 4 and IO.ingest_counts(spark, out).first()["rows"] == 6


def test_stream_counts(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1)
    rows = [(1, "this text is long enough to be kept", 5.0, "p", True, ts), (2, "short", 4.0, "p", True, ts), (3, None, 1.0, "p", True, ts), (4, "this one is not verified at all, so", 3.0, "p", False, ts)]
    df = spark.createDataFrame(rows, "review_id long, text string, rating double, parent_asin string, verified_purchase boolean, ts timestamp")
    assert [tuple(r) for r in Z.stream_ingest_counts(spark, df, str(tmp_path)).collect()] == [(0, 4, 1)]
    assert [tuple(r) for r in Z.stream_ingest_counts(spark, df.limit(2), str(tmp_path)).collect()] == [(0, 2, 1)]  # the second run's own
