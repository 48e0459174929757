"""Streams that stop and go on, replayed batches and late rows; quotas on odd ids."""

import datetime as dt
import random

from pyspark.sql import functions as F

from textlake.operators import sampling as S
from textlake.streaming import jobs as Z

DAY = dt.datetime(2024, 1, 1)


def _events(spark, minutes):
    rows = [(i, DAY + dt.timedelta(minutes=m), "a", 1.0) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")


def test_windows_go_on_after_a_restart(spark, tmp_path):
    base = str(tmp_path)
    first = Z.stream_windowed(spark, _events(spark, [1, 50, 70, 200]), "tumbling", "1 hour", delay="30 minutes", base=base)
    assert sorted(r.n for r in first.collect()) == [1, 2]  # the window of minute 200 is still open
    again = Z.stream_windowed(spark, _events(spark, [210, 400]), "tumbling", "1 hour", delay="30 minutes", base=base)
    assert sorted(r.n for r in again.collect()) == [1, 2, 2]  # ... and closes with the rows of both runs


def test_late_rows_are_counted_as_they_are_dropped(spark, tmp_path):
    early, late = _events(spark, [300, 500]), _events(spark, [10, 20, 310, 410, 480])
    rows = Z.stream_late_data(spark, [early, late], base=str(tmp_path / "report")).orderBy("batch_id").collect()
    assert [(r.input_rows, r.dropped_rows) for r in rows] == [(2, 0), (5, 4)]  # the watermark is minute 440
    base = str(tmp_path / "windows")
    Z.stream_windowed(spark, early, "tumbling", "1 hour", delay="1 hour", base=base)
    Z.stream_windowed(spark, late, "tumbling", "1 hour", delay="1 hour", base=base)
    out = Z.stream_windowed(spark, _events(spark, [5000]), "tumbling", "1 hour", delay="1 hour", base=base)
    assert out.agg(F.sum("n")).first()[0] == 2 + 5 - 4  # what Spark kept


def test_a_replayed_batch_replaces_its_own_rows(spark, tmp_path):
    stream = Z.read_stream(spark, Z.land(spark.range(5).withColumnRenamed("id", "review_id"), str(tmp_path / "in")), "review_id long")
    seen = []

    def build(batch, earlier):
        seen.append(earlier.count())
        return batch

    table = Z.append_batches(stream, str(tmp_path), "review_id long", build)
    assert table.count() == 5 and seen == [0]
    # The same batch once more, as after a failure before its commit: a new checkpoint reads the landed file again as batch 0.
    import shutil
    shutil.move(str(tmp_path / "_ckpt"), str(tmp_path / "_old"))
    kept = spark.read.parquet(str(tmp_path / "table" / "batch=0")).count()
    run = Z.append_batches  # writes the table's empty start again, keeps the batches
    assert kept == 5 and run(stream, str(tmp_path), "review_id long", build).count() == 5 and seen == [0, 0]


def test_index_holds_each_id_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some words about thing {i} and thing") for i in range(20)], "review_id long, text string")
    index = Z.stream_incremental_postings(spark, df, base=str(tmp_path))
    assert index.groupBy("review_id", "term").count().where("count > 1").count() == 0
    assert index.select("batch").distinct().count() == 1 and index.select("review_id").distinct().count() == 20
    more = spark.createDataFrame([(5, "changed"), (99, "new text here")], "review_id long, text string")
    index = Z.stream_incremental_postings(spark, more, base=str(tmp_path))
    assert {r.review_id for r in index.where("batch > 1").collect()} == {99}


def test_rows_with_null_times_are_landed(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else DAY) for i in range(100)]
    df = spark.createDataFrame(rows, "review_id long, ts timestamp")
    assert spark.read.parquet(Z.land(df, str(tmp_path / "x"))).count() == 100


def test_quota_on_sparse_and_negative_ids(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-2**62, 2**62), rng.choice("aab")) for _ in range(5000)]
    df = spark.createDataFrame(rows, "review_id long, cls string")
    for q in (1, 700, 10_000):
        got = {(r.review_id, r.cls) for r in S.quota_head(df, "cls", "review_id", q).collect()}
        want = {(i, c) for k in "ab" for i, c in sorted(x for x in rows if x[1] == k)[:q]}
        assert got == want


def test_stream_quota_over_batches(spark, tmp_path):
    rows = lambda a, b: spark.createDataFrame([(i, float(1 + i % 5)) for i in range(a, b)], "review_id long, rating double")
    Z.stream_quota(spark, rows(0, 10), 5, base=str(tmp_path))
    kept = Z.stream_quota(spark, rows(-50, 0), 5, base=str(tmp_path))
    per = {r.quota_class: r.n for r in kept.groupBy("quota_class").agg(F.count("*").alias("n")).collect()}
    assert per == {"negativo": 5, "neutro": 5, "positivo": 5}
    assert {r.review_id for r in kept.where("review_id >= 0 AND quota_class = 'negativo'").collect()} == {0, 1, 5, 6}


def test_unseen_ids_are_state_not_a_scan(spark, tmp_path):
    """Ids seen in an earlier run are dropped after a restart, and no batch plan reads the index."""
    import contextlib
    import io

    plans, base = [], str(tmp_path)

    def build(batch):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            batch.explain("extended")
        plans.append(text.getvalue())
        return batch

    before = spark.conf.get(Z.STATE_PROVIDER)
    for ids in ([1, 2, 2, 3], [3, 4, None, 1], [None, 5, 4]):
        Z.land(spark.createDataFrame([(i,) for i in ids], "review_id long"), f"{base}/input")
        table = Z.append_unseen(Z.read_stream(spark, f"{base}/input", "review_id long"), base, "review_id", "review_id long", build)
    got = sorted(((r.batch, r.review_id) for r in table.collect()), key=repr)
    assert got == sorted([(0, 1), (0, 2), (0, 3), (1, 4), (1, None), (2, 5)], key=repr)
    assert len(plans) == 3 and not any("Scan parquet" in p or "Join" in p for p in plans)  # the batch alone
    assert spark.conf.get(Z.STATE_PROVIDER) == before
