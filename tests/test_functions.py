"""Scalar functions on tiny literal frames: nulls, empty strings, double
spaces, non-ASCII, ties."""

import math

from pyspark.sql import functions as F

from textlake.functions import labels as L
from textlake.functions import text as T
from textlake.functions import vectors as VF


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_counts_and_ratios(spark):
    df = spark.createDataFrame([("ABC def!! ?",), ("",), (None,), ("ÉÑ abc",)], "text string")
    out = df.select(T.upper_count("text").alias("u"), T.char_total("text").alias("c"),
                    T.char_count("text", "!").alias("e"), T.char_count("text", "?").alias("q")).collect()
    assert (out[0]["u"], out[0]["c"], out[0]["e"], out[0]["q"]) == (3, 11, 2, 1)
    assert (out[1]["u"], out[1]["c"]) == (0, 0)
    assert out[3]["u"] == 0  # ASCII capitals only
    pct = df.select(T.uppercase_pct(T.upper_count("text"), T.char_total("text")).alias("p")).collect()
    assert pct[1]["p"] == 0.0 and pct[2]["p"] == 0.0  # 0/0 and null -> 0


def test_tokens_ttr(spark):
    df = spark.createDataFrame([("The the THE cat",), ("!!!",), (None,)], "text string")
    r = df.select(T.total_tokens(T.tokens("text")).alias("t"), T.unique_types(T.tokens("text")).alias("u")) \
        .withColumn("ttr", T.ttr("u", "t")).collect()
    assert (r[0]["t"], r[0]["u"]) == (4, 2) and math.isclose(r[0]["ttr"], 0.5)
    assert (r[1]["t"], r[1]["ttr"]) == (0, 0.0)
    assert (r[2]["t"], r[2]["u"], r[2]["ttr"]) == (0, 0, 0.0)


def test_word_counts(spark):
    assert _one(spark, T.words_space("v"), "a  b c") == 4  # double space counts an empty piece
    assert _one(spark, T.words_ws("v"), " a  b\tc\n") == 3
    assert _one(spark, T.words_ws("v"), "") == 0


def test_cleaning_and_prices(spark):
    assert _one(spark, T.text_cleaned("v"), "  Hello, World 42!\n\nOK ") == "hello world ok"
    assert _one(spark, T.text_cleaned("v"), None) == ""
    assert _one(spark, T.price_num_zero("v"), "$1,234.50") == 1234.5
    assert _one(spark, T.price_num_zero("v"), "n/a") == 0.0
    assert _one(spark, T.price_digits("v"), "from $3.99") == 3.99
    assert _one(spark, T.price_digits("v"), "n/a") is None


def test_sub_category(spark):
    assert _one(spark, T.sub_category("v"), '["Office Products", "Paper"]') == "Paper"
    assert _one(spark, T.sub_category("v"), '["Office Products","Paper"]') == "Paper"  # Spark's to_json form
    assert _one(spark, T.sub_category("v"), '["Office Products"]') == T.DEFAULT_SUBCATEGORY
    assert _one(spark, T.sub_category("v"), None) == T.DEFAULT_SUBCATEGORY


def test_labels(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (2.5,), (None,)], "r double")
    r = df.select(L.target_class("r").alias("t"), L.sentiment_class("r").alias("s"),
                  L.quota_class("r").alias("q")).collect()
    assert [x["t"] for x in r] == ["Negativo", "Negativo", "Neutro", "Positivo", "Positivo", "Positivo"]
    assert [x["s"] for x in r][:5] == [0, 0, 1, 2, 2]
    assert [x["q"] for x in r] == ["negativo", "negativo", "neutro", "positivo", None, "negativo"]


def test_label_code_strict(spark):
    import pytest
    assert _one(spark, L.label_to_code("v"), "Neutro") == 1
    with pytest.raises(Exception):
        _one(spark, L.label_to_code("v"), "Unknown")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    r = df.select(VF.l2_normalize("v").alias("n"), VF.softmax("v").alias("s"), VF.argmax("v").alias("a")).collect()
    assert r[0]["n"] == [0.6, 0.8]
    assert r[1]["n"] == [0.0, 0.0]  # zero vector stays zero
    assert math.isclose(sum(r[0]["s"]), 1.0)
    assert r[1]["a"] == 0  # first index on ties


def test_calendar(spark):
    df = spark.createDataFrame([(1704067200000,)], "ms long")  # 2024-01-01, a Monday
    r = df.select(L.iso_weekday(L.epoch_ms_to_ts("ms")).alias("d"), L.month_of(L.epoch_ms_to_ts("ms")).alias("m")) \
        .first()
    assert (r["d"], r["m"]) == (1, 1)
