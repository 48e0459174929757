"""Metric reports in every shape, ties in file order; reviews with all raw fields."""

import gzip
import json

from textlake.operators import clean as C
from textlake.sources import io as IO


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_report_shapes_and_ties(spark, tmp_path, capsys):
    a = _write(tmp_path / "a.json", json.dumps([{"model_name": "x", "f1_macro": 0.5, "training_time_sec": 3.0}, {"model_name": "z", "f1_macro": 0.1},
                                                {"model_name": "w", "f1_macro": 0.2}, {"model_name": "y", "f1_macro": 0.7, "accuracy": 0.1}]))
    b = _write(tmp_path / "b.json", json.dumps([{"model_name": "y", "f1_macro": 0.7, "accuracy": 0.9}, {"model_name": "x", "f1_macro": 0.6}]))
    c = _write(tmp_path / "c.json", json.dumps({"model_name": "n", "baseline": 1, "improved_results": {
        "f1_macro": 0.8, "training_time_seconds": 7, "per_class": {"Neutro": {"precision": 0.1, "recall": 0.2, "f1": 0.3, "support": 4}},
        "confusion_matrix": [[1, 2], [3, 4]]}}))
    bad = _write(tmp_path / "bad.json", "not json at all")
    rep = IO.load_metric_reports(spark, [bad, a, str(tmp_path / "none.json"), b, c])
    said = capsys.readouterr().out
    assert "none.json" in said and "bad.json" in said
    rows = {(r.file, r.pos): r for r in rep.collect()}
    assert len(rows) == 7 and rows[(1, 0)].training_time_seconds == 3.0
    nested = next(r for r in rows.values() if r.model_name == "n")
    assert (nested.f1_macro, nested.training_time_seconds, nested.confusion_matrix) == (0.8, 7.0, [[1, 2], [3, 4]]) and nested.per_class["Neutro"].support == 4
    best = C.dedupe_keep_best(rep.selectExpr("*", "file * 1000000 + pos AS _seq"), "model_name", "f1_macro", "_seq")
    got = {r.model_name: (r.f1_macro, r.accuracy) for r in best.collect()}
    assert got == {"x": (0.6, None), "z": (0.1, None), "w": (0.2, None), "y": (0.7, 0.1), "n": (0.8, None)}
    assert IO.load_metric_reports(spark, [str(tmp_path / "none.json")]).count() == 0


def test_reviews_keep_their_raw_fields(spark, tmp_path):
    lines = [{"review_id": 1, "rating": 5.0, "text": "t", "price": "from 12.5", "asin": "a", "user_id": "u", "images": [{"url": "x"}], "extra": 1}, "broken {"]
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)
    good, bad = IO.ingest_reviews(spark, str(tmp_path / "r.jsonl.gz"), str(tmp_path / "out"))
    r = good.first()
    assert good.count() == 1 and (r.price, r.asin, r.user_id, json.loads(r.images)) == ("from 12.5", "a", "u", [{"url": "x"}])
    assert [x[0] for x in bad.collect()] == ["broken {"]
