"""The batch encoder: hashing against its formula, failing batches, setup, and carried columns."""

import hashlib
import math

import numpy as np
import pytest

from textlake.operators.encode import Batches, HashEncoder, encode_batches, hash_embed


class Counting:
    """Vectors (length, calls of setup); batches of more than ``most`` texts fail."""

    def __init__(self, most=10 ** 9):
        self.most, self.ready = most, 0

    def inputs(self, text_col):
        from pyspark.sql import functions as F

        return F.col(text_col)

    def setup(self):
        self.ready += 1

    def encode(self, texts):
        if len(texts) > self.most:
            raise MemoryError(len(texts))
        return [[len(t), self.ready] for t in texts]


def test_hashing_equals_its_formula(spark):
    texts = [(1, "Red stapler, the red one"), (2, ""), (3, None), (4, "the and of"), (5, "ünïcode wörds 42 _x")]
    want = {}
    for i, tokens in ((1, ["red", "stapler", "red", "one"]), (2, []), (3, []), (4, []), (5, ["ünïcode", "wörds", "42", "_x"])):
        v = [0.0] * 32
        for t in tokens:
            d = hashlib.md5(t.encode()).hexdigest()
            v[int(d[:8], 16) % 32] += 1 if int(d[8], 16) % 2 == 0 else -1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        want[i] = [x / norm for x in v]
    got = {r.review_id: r.embedding for r in hash_embed(spark.createDataFrame(texts, "review_id long, text string"), "review_id", "text", 32).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose(got[i], want[i])


def test_batches_are_halved_and_repeated(spark):
    seen = []

    class Failing(Counting):
        def encode(self, texts):
            seen.append(len(texts))
            return super().encode(texts)

    out = Batches(Failing(3), 16).run([str(i) for i in range(20)])
    assert len(out) == 20 and seen[:4] == [16, 8, 4, 2] and set(seen[4:]) == {2}
    with pytest.raises(MemoryError):
        Batches(Counting(0), 4).run(["a", "b"])
    rows = spark.createDataFrame([(i, "x" * i, "keep") for i in range(50)], "review_id long, text string, embedding string").repartition(2)
    out = encode_batches(rows, Counting(5), batch=16).collect()
    assert sorted((r.review_id, r.text, r.embedding) for r in out) == [(i, "x" * i, [float(i), 1.0]) for i in range(50)]
    assert encode_batches(rows.limit(0), Counting()).count() == 0
