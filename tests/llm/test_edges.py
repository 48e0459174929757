"""Every operator and stage on awkward tables: defined rows, no crash."""

import math

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, PLAIN, ROWS
from textlake.llm import line_chunks, quality_knn, secret_scan, temperature_mix, token_frames
from textlake.llm.bbit_minhash import near_duplicates
from textlake.llm.kmeans_tree import nearest
from textlake.llm.langid_zstd import identify_language, learn_dictionaries
from textlake.llm.language_model import score_documents
from textlake.llm.winnow import contamination

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df, *cols):
    return sorted([tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()], key=repr)


def labels(spark, rows=((1, 1, 0), (2, 0, 0), (7, 1, None), (8, 0, 0), (8, None, 1), (None, 1, 0), (99, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_quality(spark, edge_docs, no_docs):
    model = quality_knn.learn(edge_docs, labels(spark))
    got = quality_knn.score_quality(edge_docs, model)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in rows if r.doc_id in (3, 4)} == {model["prior"]}
    assert quality_knn.score_quality(no_docs, model).count() == 0
    blank = quality_knn.learn(no_docs, labels(spark, []))
    assert {r.score for r in quality_knn.score_quality(edge_docs, blank).collect()} == {0.5}


def test_secrets(spark, edge_docs, no_docs):
    rows = secret_scan.scan_secrets(edge_docs).collect()
    assert len(rows) == len(ROWS)
    assert all(not r.spans for r in rows if r.doc_id in (3, 4, 8))
    assert secret_scan.scan_secrets(no_docs).count() == 0


def test_language(spark, edge_docs, no_docs):
    learned = learn_dictionaries(edge_docs)
    assert set(learned) <= {"en", "de"}
    rows = identify_language(edge_docs, learned).collect()
    assert len(rows) == len(ROWS)
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (3, 4, 8)} == {("und", 0.0)}
    assert all(r.lang_pred in learned for r in rows if r.doc_id in (1, 7, 9, 10))
    assert learn_dictionaries(no_docs) == {} and identify_language(no_docs, {}).count() == 0
    assert {r.lang_pred for r in identify_language(edge_docs, {}).collect()} == {"und"}


def test_lines(spark, edge_docs, no_docs):
    rows = line_chunks.remove_repeated_chunks(edge_docs).collect()
    assert len(rows) == len(ROWS)
    assert sum(r.text is None and r.n_lines == 0 for r in rows) == 2
    assert [(r.n_lines, r.text) for r in rows if r.doc_id == 4] == [(1, "")]
    assert [r.text for r in rows if r.doc_id == 7] == [LONG]
    assert line_chunks.remove_repeated_chunks(no_docs).count() == 0


def test_contamination(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "brown fox jumps over the lazy dog and runs far away"), (1, "Lazy dog"), (2, None), (3, ""), (None, "quick BROWN"),
                                   (5, "w5x5 w6x6"), (5, "w5x5 w6x6")], "item_id long, text string")
    got = {}
    for r in contamination(edge_docs, bench).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.item_ids, r.contaminated))
    assert got[1] == [(24, 11 + 1, ["1"], True)] * 2 and got[2] == got[1][:1]  # the item's 11 words and "quick"
    assert got[3] == got[4] == got[8] == [(0, 0, [], False)]
    assert got[7][0][2] == ["5"] and len(got[None]) == 3
    assert contamination(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in contamination(edge_docs, bench.limit(0)).collect())


def test_tokens(spark, edge_docs, no_docs):
    rows = token_frames.tokens_round_trip(edge_docs, TOKENIZER).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids[:3] == [None] * 3 and ids[3:] == sorted(i for i, *_ in ROWS if i is not None)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    assert token_frames.tokens_round_trip(no_docs, TOKENIZER).count() == 0


def test_nearest(spark):
    bad = [None, [], [0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0], [1.0, None], [1.0, 2.0, 3.0]]
    rows = [(i, [1.0, float(i)]) for i in range(0, 8)] + [(100 + i, v) for i, v in enumerate(bad)] + [(None, [1.0, 1.0]), (0, [1.0, 0.0]), (50, [2.0, 14.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("x")).withColumn("score", F.lit(1))
    got = nearest(df, lambda i: i % 50 == 0, k=5).collect()
    assert {r.query_id for r in got} == {0, 50}
    first = sorted((r.rank, r.vec_id) for r in got if r.query_id == 50)
    assert first == [(1, 7), (2, 6), (3, 5), (4, 4), (5, 3)]
    assert not any(r.vec_id == r.query_id for r in got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in nearest(few, lambda i: i % 50 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_language_model(spark, edge_docs, no_docs):
    rows = score_documents(edge_docs, edge_docs.where("doc_id < 5"), keep=("score", "rid")).collect()
    assert len(rows) == len(ROWS)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    assert all(r[6] < 0 or r.n_tokens == 0 for r in rows)
    none = score_documents(edge_docs, no_docs).collect()
    assert len(none) == len(ROWS) and all(r.n_known == 0 and r.train_tokens == 0 for r in none)
    assert score_documents(no_docs, edge_docs).count() == 0


def test_near_duplicates(spark, edge_docs, no_docs):
    got = by_id(near_duplicates(edge_docs), "n_shingles", "component_id", "kept")
    n = len(PLAIN.split()) - 4
    assert got.count((1, n, 1, True)) == 2 and (2, n, 1, False) in got and (10, n, 1, False) in got
    assert (3, 0, 3, True) in got and (4, 0, 4, True) in got and (8, 1, 8, True) in got
    assert got.count((None, n, None, True)) == 2 and (None, 0, None, True) in got
    assert near_duplicates(no_docs).count() == 0


def test_mixing(spark, edge_docs, no_docs):
    rows = temperature_mix.mix_sources(edge_docs).collect()
    once = sorted((repr(r.doc_id), r.source) for r in rows if r.epoch == 0)
    assert once == sorted((repr(i), s or "") for i, _, _, s in ROWS)
    assert abs(sum({r.source: r.weight for r in rows}.values()) - 1) < 1e-9
    assert temperature_mix.mix_sources(no_docs).count() == 0


@pytest.mark.parametrize("which", ["edge_docs", "no_docs"])
def test_stages(spark, which, request, tmp_path):
    import corpus_pipeline

    docs = request.getfixturevalue(which)
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        rows = out.collect()
        if name != "token files":
            assert out.columns == docs.columns, name
        if which == "no_docs":
            assert rows == []
        elif name == "near duplicates":
            assert sum(r.text == PLAIN for r in rows) == 2  # of the id 1, and of the null ids
        elif name == "benchmark decontamination":
            assert sorted(r.doc_id or 0 for r in rows) == [0, 3, 4, 7, 8, 9]
        elif name == "temperature mixing":
            assert len(rows) >= len(ROWS)
        elif name == "token files":
            assert len(rows) == len(ROWS)
