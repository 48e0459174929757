"""The fan-out join: equal to a plain left join, hot keys cut into cells."""

import random

import pytest
from pyspark.sql import functions as F

from textlake.operators import joins as J


def sides(spark, n, shared, extra=()):
    rng = random.Random(n)
    left = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(n)] + [(10_000, None), (10_001, "left only")] + [(20_000 + i, "hot left") for i in range(n // 3)]
    right = [("hot" if i % 3 == 0 else f"t{i % 70}", i) for i in range(shared)] + [(None, -1), ("right only", -2)] + [("hot right", -3 - i) for i in range(n // 3)] + list(extra)
    rng.shuffle(left), rng.shuffle(right)
    return spark.createDataFrame(left, "review_id long, text string"), spark.createDataFrame(right, "text string, timestamp long")


@pytest.mark.parametrize("part_rows", [7, 20, 1000])
def test_equals_plain_left_join(spark, part_rows):
    left, right = sides(spark, 150, 120, [("hot left", 7)])
    want = left.join(right, "text", "left").select("review_id", "text", "timestamp")
    got = J.fan_out_join(left, right, "text", part_rows).select("review_id", "text", "timestamp")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_hot_text_is_spread(spark):
    """One text is a third of both sides: no cell holds more than about a part of each."""
    left, right = sides(spark, 900, 900)
    hot, grid_l, grid_r, cold_l, cold_r = J.fan_out_parts(left, right, "text", 50)
    assert {r["_d"] for r in hot.select("_d").collect()} == {left.where("text = 'hot'").select(F.sha2("text", 256)).first()[0]}
    assert cold_l.where("text = 'hot'").count() == 0 == cold_r.where("text = 'hot'").count()
    for grid in (grid_l, grid_r):
        sizes = [r["n"] for r in grid.groupBy("_d", "_i", "_j").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 36 and max(sizes) < 100
    assert J.fan_out_join(left, right, "text", 50).where("text = 'hot'").count() == 300 * 300


def test_empty_sides(spark):
    left, right = sides(spark, 30, 30)
    assert J.fan_out_join(left.limit(0), right, "text", 5).count() == 0
    got = J.fan_out_join(left, right.limit(0), "text", 5)
    assert got.count() == left.count() and got.where("timestamp IS NOT NULL").count() == 0
