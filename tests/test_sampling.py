"""Properties of the bucketed exact-rank samplers: exact counts, disjoint and
complete splits, independence from partitioning, equality with the plain
window."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from textlake.operators import sampling as S


def _frame(spark, n=3000):
    df = spark.range(n).select(F.col("id").alias("review_id"),
                               F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b")
                               .otherwise("c").alias("cls"))
    return df


def test_balance_exact(spark):
    df = _frame(spark)
    out = S.balance_classes(df, "cls", "review_id", cap=500)
    counts = {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()}
    assert counts == {"a": 300, "b": 300, "c": 300}  # min(cap, minority = 300)


def test_matches_plain_window(spark):
    df = _frame(spark)
    got = {r["review_id"] for r in S.equal_per_class(df, "cls", 150, 3).collect()}
    w = Window.partitionBy("cls").orderBy(S.hash_key("review_id"), "review_id")
    want = {r["review_id"] for r in df.withColumn("rn", F.row_number().over(w)).where("rn <= 50").collect()}
    assert got == want


def test_stable_under_repartition(spark):
    df = _frame(spark)
    a = {r["review_id"] for r in S.sample_n(df, 123).collect()}
    b = {r["review_id"] for r in S.sample_n(df.repartition(7), 123).collect()}
    assert a == b and len(a) == 123


def test_split_disjoint_complete(spark):
    df = _frame(spark)
    s = S.train_val_test_split(df, "cls").collect()
    assert len(s) == 3000 and len({r["review_id"] for r in s}) == 3000
    per = {}
    for r in s:
        per.setdefault((r["cls"], r["split"]), 0)
        per[(r["cls"], r["split"])] += 1
    # class a: 2100 rows -> test ceil(0.15*2100)=315, val ceil(0.176*1785)=315
    assert per[("a", "test")] == 315 and per[("a", "val")] == 315 and per[("a", "train")] == 1470


def test_shuffle_positions(spark):
    df = _frame(spark, 500)
    pos = sorted(r["position"] for r in S.shuffle_rows(df).collect())
    assert pos == list(range(1, 501))


def test_bernoulli_fraction(spark):
    df = _frame(spark, 20000)
    n = S.bernoulli(df, 0.3).count()
    assert 5600 < n < 6400
