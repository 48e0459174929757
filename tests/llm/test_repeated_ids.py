"""Different texts under one id, and ids that hold many rows."""

from collections import Counter

import numpy as np

import corpus_pipeline
from textlake.llm import quality_knn, temperature_mix
from textlake.llm.bbit_minhash import near_duplicates

SCHEMA = "doc_id long, text string"


def _family(name: str, n: int = 40) -> tuple[str, str]:
    words = [f"{name}{i}" for i in range(n)]
    return " ".join(words), " ".join([*words, f"{name}end"])


def test_two_texts_of_one_id(spark):
    (a, a2), (b, b2) = _family("a"), _family("b")
    docs = spark.createDataFrame([(9, a), (9, b), (5, a2), (20, a2), (3, b2), (21, b2)], SCHEMA)
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {(9, 5, False), (9, 3, False), (5, 5, True), (20, 5, False), (3, 3, True), (21, 3, False)}
    left = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted(map(tuple, left)) == [(3, b2), (5, a2)]


def test_near_copies_of_the_same_id(spark):
    """The smallest id of a component has two of its texts, one of them repeated."""
    a, a2 = _family("a")
    other = "something else that stands alone here"
    docs = spark.createDataFrame([(1, a), (1, a2), (1, a2), (1, other), (4, a), (None, a)], SCHEMA)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(docs).collect()) == [(0, 0, True), *[(1, 1, True)] * 4, (4, 1, False)]
    left = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert len(left) == 3 and (1, other) in left and (None, a) in left and len({(1, a), (1, a2)} & set(left)) == 1


def test_small_sets_are_linked_without_an_estimate(spark):
    """Pairs of 3 or 4 equal shingles of 4, at the threshold."""
    rows, links = [], {}
    for i in range(300):
        w = [f"p{i}x{j}" for j in range(8)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1]))]
        links[2 * i], links[2 * i + 1] = 2 * i, 2 * i
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == links


def test_hot_ids_are_spread_over_blocks(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "s", "a b c d e") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = temperature_mix.mix_sources(docs, block=250).where("epoch = 0").collect()
    size = Counter()
    for r in got:
        size[r.block_place] += r.n_tokens
    assert len(got) == 3000 and len(size) == 60 and max(size.values()) < 600
    assert sorted((r.doc_id or 0) for r in got) == sorted((i or 0) for i, _, _ in rows)


def test_learning_from_repeated_ids(spark):
    docs = [(i % 40, f"text number {i} of some words") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    models = [quality_knn.learn(spark.createDataFrame(rows, SCHEMA).repartition(n), labels) for rows, n in ((docs, 1), (docs[::-1], 5))]
    assert np.array_equal(models[0]["labels"], models[1]["labels"]) and np.allclose(models[0]["vectors"], models[1]["vectors"])
