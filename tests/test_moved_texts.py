"""Texts are moved only for those who read them; dense nodes read only the features they draw."""

import numpy as np
import pandas as pd

from textlake.operators import clean as C
from textlake.operators import forest as FO
from textlake.operators import joins as J


def _plan(df, node: str) -> list[str]:
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if node in line]


def test_dedupe_moves_no_text_unless_read(spark):
    """Fails before: the kept row was one struct with the text in it."""
    rows = spark.createDataFrame([(3, "a", 1.0), (1, "a", 2.0), (None, "b", 3.0), (5, None, 4.0), (4, None, 5.0)], "review_id long, text string, rating double")
    ids = C.dedupe_text(rows).select("review_id", "rating")
    assert _plan(ids, "Aggregate") and not any("text" in line for line in _plan(ids, "Aggregate"))
    got = C.dedupe_text(rows)
    assert got.columns == rows.columns and {tuple(r) for r in got.collect()} == {(1, "a", 2.0), (None, "b", 3.0), (4, None, 5.0)}


def test_fan_out_joins_by_digest(spark):
    """Fails before: texts of both sides were moved to be joined."""
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "review_id long, text string")
    right = spark.createDataFrame([("a", 7), ("a", 8), (None, 9)], "text string, timestamp long")
    out = J.fan_out_join(left, right, "text")
    assert out.columns == ["text", "review_id", "timestamp"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 1, 7), ("a", 1, 8), ("b", 2, None), (None, 3, None)], key=str)
    joins = _plan(out.select("review_id", "timestamp"), "Join")
    assert joins and not any("text" in line for line in joins)


def test_dense_nodes_read_drawn_features(monkeypatch):
    """Fails before: every node read all cells of its rows, or whole columns."""
    rng = np.random.default_rng(2)
    x = rng.integers(1, 8, (300, 12)).astype(np.uint8)
    label = (x[:, 4] + rng.integers(0, 3, 300) > 5).astype(int)

    def grown(width: int) -> pd.DataFrame:
        edges = np.full((width, 7), np.inf)
        edges[:12] = np.arange(7) + 0.5
        rows = pd.DataFrame({"label": label, "w": 1.0 + label, "n": 1, "j": [np.arange(12, dtype=np.int32).tobytes()] * 300, "b": [r.tobytes() for r in x]})
        return FO._Grower(edges, 2, width, 6, 2, 0.0, 5).subtree((0, 1), rows)

    sparse = grown(60)  # features without a threshold are never split
    monkeypatch.setattr(FO, "_ranges", None)
    pd.testing.assert_frame_equal(grown(12), sparse)
    assert len(sparse) > 20


def test_rows_are_cleaned_and_encoded_once(spark, tmp_path, monkeypatch):
    """Fails before: cleaning ran for the encoder and for the features, and every reader encoded all rows again."""
    import pytest

    from textlake.operators import encode as EN
    from textlake.operators import models as M
    from textlake.plans import q_ml

    docs = [(i, f"Word{i % 7} word{i % 5} good bad fine text number {i}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "2024-01-01 00:00:00")], "event_id long, ts string").write.parquet(f"{tmp_path}/events.parquet")
    parts = [(i, "n", "b", "t", 1.0) for i in range(20)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")

    def classifier(train):
        assert not _plan(train, "MapInArrow")
        raise KeyError("seen")

    monkeypatch.setattr(M, "text_classifier", lambda train: M.Pipeline(stages=[M.TextEncoder(dim=8), M.Normalizer(inputCol="emb_vec", outputCol="features"), M.logreg(max_iter=1)(train)]))
    monkeypatch.setattr(M, "embedding_classifier", classifier)
    with pytest.raises(KeyError, match="seen"):
        q_ml.text_model_roundtrip(spark, str(tmp_path))

    def encode(rows):
        assert not _plan(rows, "Join") and not _plan(rows, "Aggregate")
        return EN.hash_embed(rows, "review_id", "text")

    frame = M.embedding_frame(q_ml.C.clean_reviews(q_ml.V.reviews(spark, str(tmp_path)), q_ml.V.products(spark, str(tmp_path))), encode)
    assert frame.count() > 10
