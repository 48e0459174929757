"""Written indexes: reuse, manifests, blocks that are not read, and searches equal to plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.operators import indexes as IX
from textlake.operators import search as R
from textlake.operators import text as TX
from textlake.operators.encode import hash_embed


@pytest.fixture
def corpus(spark):
    """Many filler documents; few hold a rare word, at very different weights."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["filler", "common", "plain", "stuff"]) for _ in range(rng.randrange(3, 40))) + (" needle" * (1 + i % 7) if i % 9 == 0 else "")) for i in range(500)]
    return spark.createDataFrame(rows + [(900, None), (901, "")], "review_id long, text string")


QUERIES = [(1, "needle filler"), (2, "common plain"), (3, " "), (4, "unknownword"), (5, "needle needle stuff")]


def plain_hits(corpus, queries, k):
    """Cosine of TF-IDF rows by dictionaries."""
    def tf(text):
        out = {}
        for w in (text or "").split():
            out[w] = out.get(w, 0) + 1
        return out

    docs = {r.review_id: tf(r.text) for r in corpus.collect()}
    df = {}
    for d in docs.values():
        for w in d:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(counts):
        w = {t: c * idf[t] for t, c in counts.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    docs = {i: unit(d) for i, d in docs.items()}
    out = []
    for qid, text in queries:
        q = unit(tf(text)) if text.strip() else {}
        scores = sorted(((-round(sum(x * d.get(t, 0) for t, x in q.items()), 6), i) for i, d in docs.items()))
        out += [(qid, i, -s, r + 1) for r, (s, i) in enumerate([x for x in scores if x[0] < 0][:k])]
    return out


def test_lexical_blocks_are_skipped_and_hits_exact(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK_DOCS", 8)
    index = R.build_lexical_index(corpus, root=str(tmp_path))
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    plan = R.lexical_plan(index, queries, 3)
    rare = "query_id in (1, 5)"
    considered, read = plan.bounds.where(rare).count(), 2 * R.SEED_BLOCKS + plan.rest.where(rare).count()
    assert considered == 126 and read < considered / 2  # most blocks cannot reach the third score
    got = sorted((r.query_id, r.rank, r.review_id, r.score) for r in R.lexical_search(index, queries, 10).collect())
    want = sorted((q, rank, i, s) for q, i, s, rank in plain_hits(corpus, QUERIES, 10))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-6)


def test_lexical_index_is_written_once(spark, corpus, tmp_path, monkeypatch):
    first = R.build_lexical_index(corpus, root=str(tmp_path))
    assert first.manifest["n_docs"] == 502 and first.manifest["terms"] == 5 and first.manifest["postings"] == first.blocks.agg(F.sum(F.size("postings"))).first()[0]

    def tokenised(*_, **__):
        raise AssertionError("the corpus was tokenised again")

    with monkeypatch.context() as m:
        m.setattr(TX, "term_counts", tokenised)
        again = R.build_lexical_index(corpus.orderBy(F.rand(1)), root=str(tmp_path))
        with pytest.raises(AssertionError):
            R.build_lexical_index(corpus.where("review_id <> 4"), root=str(tmp_path))
        with pytest.raises(AssertionError):
            R.build_lexical_index(corpus, stop_words=("filler",), root=str(tmp_path))
    assert again.manifest == first.manifest


def test_unfinished_index_is_built_again(spark, corpus, tmp_path):
    first = R.build_lexical_index(corpus, root=str(tmp_path))
    folder = first.manifest["data"].rsplit("/", 1)[0]
    spark.createDataFrame([], "value string").write.mode("overwrite").text(f"{folder}/manifest")
    again = R.build_lexical_index(corpus, root=str(tmp_path))
    assert again.manifest["data"] != first.manifest["data"] and again.blocks.count() == first.blocks.count()


def test_empty_corpus(spark, tmp_path):
    index = R.build_lexical_index(spark.createDataFrame([], "review_id long, text string"), root=str(tmp_path))
    assert R.lexical_search(index, spark.createDataFrame(QUERIES, "query_id long, query string")).count() == 0
    vectors = IX.open_vector_index(spark.createDataFrame([], "review_id long, embedding array<double>"), root=str(tmp_path))
    assert vectors.manifest["n"] == 0 and vectors.manifest["bytes"] == 0
    assert R.semantic_search(vectors, spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>")).count() == 0


def test_vector_blocks_meet_all_query_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK_ROWS", 40)
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[50] = 0
    vectors = spark.createDataFrame([(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)], "review_id long, embedding array<double>, label int")
    index = IX.open_vector_index(vectors, keep=["label"], root=str(tmp_path))
    m = index.manifest
    assert (m["n"], m["n_blocks"], m["dimension"], m["bytes"]) == (300, 8, 6, 300 * 6 * 8) and m["checksum"].isdigit() and m["built_at"] > "2020"
    assert IX.open_vector_index(vectors, keep=["label"], root=str(tmp_path)).manifest == m
    other = IX.open_vector_index(vectors.where("review_id > 0"), keep=["label"], root=str(tmp_path)).manifest
    assert other["checksum"] != m["checksum"] and other["data"] != m["data"]
    queries = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x[:30])] + [(99, None)], "query_id long, vec array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    unit[50] = 0
    scores = np.round(unit @ x[:30].T, 6) + 0.0
    for threshold in (None, 1.0):
        got = sorted((r.query_id, r["rank"], r.review_id) for r in R.semantic_search(index, queries, 5, threshold=threshold).collect())
        want = []
        for q in range(30):
            top = [i for i in np.lexsort((np.arange(300), -scores[:, q])) if threshold is None or scores[i, q] >= threshold][:5]
            want += [(q, r + 1, int(i)) for r, i in enumerate(top)]
        assert got == sorted(want)


def test_search_from_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red stapler works"), (2, "blue paper tray"), (3, "green marker pen")], "review_id long, text string")
    index = IX.open_vector_index(hash_embed(docs, "review_id", "text"), root=str(tmp_path))
    asked = spark.createDataFrame([(10, "paper tray blue"), (11, "marker")], "query_id long, query string")
    hits = IX.search_texts(index, asked, lambda d: hash_embed(d, "query_id", "query"), k=1).collect()
    assert {(h.query_id, h.review_id) for h in hits} == {(10, 2), (11, 3)} and abs([h.score for h in hits if h.query_id == 10][0] - 1) < 1e-6
