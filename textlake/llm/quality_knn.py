"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a vector of word forms (case, closing punctuation, digits,
length class, repetition of the word before) and of hashed words, as square
roots of shares, weighted by inverse document frequency. A truncated singular
value decomposition of the labelled sample gives the latent space. The labelled
vectors are broadcast; every document gets its exact cosine to each of them, in
blocks, and its K nearest vote with weight cosine**POWER.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import held_out, row_blocks, text_buffer
from textlake.llm.words import SPACE, U, Words, mix

#: Bounds of the fitted model: labelled rows, latent dimensions, hashed forms and words.
SAMPLE, RANK = 4096, 48
FORMS, WORDS = 512, 2048
FORM_WEIGHT, WORD_WEIGHT = 1.0, 0.35
K, POWER = 25, 8
THRESHOLD = 0.3


class Features:
    """Row vectors of hashed word forms and words of a text buffer."""

    def __init__(self):
        self.hasher = Words(SPACE)
        kind = np.zeros(256, np.int64)  # 0 symbol, 1 lower, 2 upper, 3 digit
        kind[97:123], kind[128:] = 1, 1
        kind[65:91], kind[48:58] = 2, 3
        self.upper, self.digit, self.symbol, self.kind = kind == 2, kind == 3, kind == 0, kind

    def rows(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        s, e, h, row = self.hasher.find(buf, offs)
        out = np.zeros((n, FORMS + WORDS), np.float32)
        if not len(s):
            return out
        base = int(offs[0])
        body = buf[base:int(offs[-1])]
        total = lambda flags: np.concatenate(([0], np.cumsum(flags[body], dtype=np.int32)))
        up, num, sym = total(self.upper), total(self.digit), total(self.symbol)
        a, b = s - base, e - base
        size, ups, nums, syms = b - a, up[b] - up[a], num[b] - num[a], sym[b] - sym[a]
        last, before, first = buf[e - 1], buf[np.maximum(e - 2, s)], self.kind[buf[s]]
        end = np.where(self.symbol[last], last, 0).astype(np.int64)
        double = self.symbol[last] & (before == last) & (size > 1)
        case = np.where(ups == 0, 0, np.where((ups == 1) & (first == 2), 1, np.where(ups + syms + nums == size, 2, 3)))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        parts = (first, case, end, double, np.minimum(syms, 4), nums > 0, np.minimum(size // 6, 4), again)
        code = np.zeros(len(h), U)
        for p in parts:
            code = code * U(257) + p.astype(U) + U(1)
        form = (mix(code) % U(FORMS)).astype(np.int64)
        word = (mix(h) % U(WORDS)).astype(np.int64)
        width = FORMS + WORDS
        forms = np.bincount(row * FORMS + form, minlength=n * FORMS).reshape(n, FORMS)
        words = np.bincount(row * WORDS + word, minlength=n * WORDS).reshape(n, WORDS)
        count = np.maximum(forms.sum(axis=1, keepdims=True), 1)
        out[:, :FORMS], out[:, FORMS:width] = np.sqrt(forms / count), np.sqrt(words / count)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(rows: list[tuple[str | None, int]]) -> dict:
    """Latent space and labelled vectors of (text, label) rows."""
    feats = Features()
    x = [feats.rows(*text_buffer(pa.array([t or "" for t, _ in rows[i:i + 256]]))) for i in range(0, len(rows), 256)]
    return fit_vectors(np.concatenate([np.zeros((0, FORMS + WORDS), np.float32), *x]), [v for _, v in rows])


def fit_vectors(x: np.ndarray, values: list[int]) -> dict:
    """Latent space and labelled vectors of feature rows and their labels."""
    if not len(x):
        return {"space": np.zeros((FORMS + WORDS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": np.zeros(0), "prior": 0.5}
    idf = np.log1p(len(x) / (1.0 + (x > 0).sum(axis=0)))
    weight = (idf * np.where(np.arange(x.shape[1]) < FORMS, FORM_WEIGHT, WORD_WEIGHT)).astype(np.float32)
    x *= weight
    rank = min(RANK, *x.shape)
    y = x @ np.random.default_rng(1).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):  # subspace iteration for the leading singular vectors
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    space = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T * weight[:, None]
    labels = np.array(values, np.float64)
    plain = x / np.maximum(weight, 1e-12)
    return {"space": space.astype(np.float32), "vectors": _unit(plain @ space).astype(np.float32), "labels": labels, "prior": float(labels.mean())}


def vote(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows; rows without features get the label's share."""
    z = _unit(x @ model["space"])
    out = np.full(len(x), model["prior"])
    if not len(model["labels"]):
        return out
    cosine = z @ model["vectors"].T
    k = min(K, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cosine, near, axis=1).astype(np.float64), 0) ** POWER
    total = w.sum(axis=1)
    score = (w * model["labels"][near]).sum(axis=1) / np.maximum(total, 1e-12)
    ok = (total > 1e-9) & (x.any(axis=1))
    out[ok] = np.clip(score[ok], 0, 1)
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Fit on SAMPLE labelled documents, those of smallest id hash, outside the
    held-out fifth. Null labels are left out; a repeated id counts once, by its
    largest label and its text of the smallest hash. The driver receives
    features, not texts: (FORMS + WORDS) floats a document."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), 0))
    known = known.groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).alias("label"))
    ids = docs.select(F.col(id_col).alias("k")).join(known, "k").dropDuplicates(["k"])
    ids = ids.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).toPandas()
    rows = docs.where(F.col(id_col).isin(ids["k"].tolist())).select(F.col(id_col).alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def features(batches):
        feats = Features()
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            for i, j in row_blocks(offs, 2 << 20):
                for a in range(i, j, 256):
                    b = min(j, a + 256)
                    x = feats.rows(buf, offs[a:b + 1])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("k", "h")), pa.array([r.tobytes() for r in x], pa.binary())], names=["k", "h", "x"])

    rows = rows.mapInArrow(features, f"k {rows.schema['k'].dataType.simpleString()}, h long, x binary")
    found = dict(rows.groupBy("k").agg(F.min_by("x", "h").alias("x")).toPandas().itertuples(index=False, name=None))
    x = [np.frombuffer(found[k], np.float32) for k in ids["k"]]
    return fit_vectors(np.stack(x) if x else np.zeros((0, FORMS + WORDS), np.float32), [int(v) for v in ids["label"]])


def score_quality(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, score, predicted), one row per row of ``docs``; ``score`` in
    [0, 1] grows with quality. Null, empty and blank texts score the share of
    label 1 in the sample. Only the text is looked at; the columns ``keep`` are
    passed on, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    rows, n = docs.select(*own, F.col(text_col).alias("text")), len(own)

    def score(batches):
        feats = Features()
        for batch in batches:
            buf, offs = text_buffer(batch.column(n))
            for i, j in row_blocks(offs, 2 << 20):
                for a in range(i, j, 512):
                    b = min(j, a + 512)
                    s = vote(sent.value, feats.rows(buf, offs[a:b + 1]))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(n)), pa.array(s)],
                                                     names=[*(f"_{c}" for c in range(n)), "score"])

    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text") + "score double"
    out = rows.mapInArrow(score, shape)
    back = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*back, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
