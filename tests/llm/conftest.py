import pytest

#: Names that the operators use for columns of their own.
CLASHING = ("id", "rid", "row", "score", "predicted", "hash", "chunks", "spans", "component", "kept", "start", "u", "v", "h", "n", "p",
            "tokens", "total", "epoch", "block", "leaf", "marks", "label", "k", "row_key", "uses", "in_doc_id", "in_text")

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000)) + " " + "z" * 200_000
PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from the old red barn while it rains\nsecond line here"

ROWS = [
    (1, PLAIN, "en", "a"),
    (2, PLAIN, "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (None, PLAIN, "en", "a"),
    (None, PLAIN, "en", "a"),
    (7, LONG, "en", "b"),
    (8, " .,;!? \n\n\t-- ", "de", None),
    (1, PLAIN, "en", "a"),
    (9, "añö 日本語 ÄÖÜ ñandú — “quoted” text\r\nwith odd\x0bbreaks", "de", "c"),
    (10, PLAIN.replace("here", "there"), None, "c"),
    (None, None, None, None),
]


def _frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, extra columns."""
    return _frame(spark, ROWS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return _frame(spark, [])
